import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators.chunking import chunk_entries, pack


def packed(spark, texts, limit, least=200, overlap=1):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, p array<string>")
    return [r.c for r in df.select("k", pack(F.col("p"), F.lit(limit), least, overlap).alias("c")).orderBy("k").collect()]


def test_packing(spark):
    got = packed(spark, [["a" * 900] * 3, ["One two. " * 300], ["a" * 1900, "tiny"], ["b" * 50], [], ["x" * 3000]], 2000)
    assert got[0] == ["a" * 900 + "\n\n" + "a" * 900, "a" * 900]
    assert len(got[1]) == 2 and all(len(c) <= 2000 for c in got[1])
    assert got[2] == ["a" * 1900 + "\n\ntiny"] and got[3] == ["b" * 50] and got[4] == [] and got[5] == ["x" * 3000]


def test_sentences_overlap(spark):
    (runs,) = packed(spark, [[" ".join(f"Sentence number {k} here." for k in range(30))]], 200, 0)
    for a, b in zip(runs, runs[1:]):
        assert b.startswith(a.split(". ")[-1].rstrip("."))


def test_nothing_is_lost(spark):
    rng = random.Random(4)
    texts = [[rng.choice("abcdefg") * rng.randint(1, 120) for _ in range(rng.randint(0, 20))] for _ in range(60)]
    for parts, chunks in zip(texts, packed(spark, texts, 150, 20)):
        assert "\n\n".join(chunks) == "\n\n".join(parts)
        assert all(len(c) <= 150 for c in chunks[:-1])


def test_entries(spark):
    rows = [
        ("e#0001", "2012-03-04", "klow", "a" * 1000 + "\n\n" + "b" * 1000, "f.docx", [("p.jpg", "link", "exact")], ["reconstructed", "out_of_order"]),
        ("e#0002", None, "klow", "text", "f.docx", [], []), ("e#0003", "2012-03-05", None, " \n ", "f.docx", [], []),
        ("e#0004", "2012-03-06", " ", "short", "f.docx", None, None), ("e#0005", "2012-03-07", "x", None, "f.docx", [], []),
    ]
    schema = "id string, entry_date string, trip string, text string, source_file string, photos array<struct<path:string,source:string,resolved:string>>, warnings array<string>"
    got = chunk_entries(spark.createDataFrame(rows, schema), limit=1600).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in got] == ["e#0001/0", "e#0001/1", "e#0004/0"]
    assert got[0].text.startswith("2012-03-04, klow — a") and got[0].warnings == ["reconstructed", "split"] and got[0].n_photos == 1
    assert got[2].text == "2012-03-06 — short" and got[2].header_len == 13 and got[2].n_photos == 0
