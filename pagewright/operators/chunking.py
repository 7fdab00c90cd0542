"""Entries packed into chunks that carry their day and trip."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from pagewright.functions import text as T

LIMIT, LEAST, OVERLAP = 1600, 200, 1


_SENTENCE = re.compile(T.SENTENCE, re.ASCII)


def _spans(sizes: list[int], limit: int, gap: int, slack: int = 0, overlap: int = 0) -> Iterator[tuple[int, int]]:
    """(start, end) of greedy runs of items: each as long as its items and a ``gap`` behind each, the last one's less ``slack``, allow.

    A run begins ``overlap`` items before the end of the one before, and takes one more item in any case.
    """
    ends = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64) + gap)])
    start = end = 0
    while end < len(sizes):
        start = max(end - overlap, 0)
        end = max(end + 1, int(np.searchsorted(ends, ends[start] + limit + slack, side="right")) - 1)
        yield start, end


def sentence_runs(paragraph: str, limit: int, overlap: int = OVERLAP) -> list[str]:
    """A paragraph over the limit as runs of sentences; each run opens with the last ``overlap`` sentences before it."""
    parts = [x for x in _SENTENCE.split(paragraph) if x.strip(" ")]
    return [" ".join(parts[a:b]) for a, b in _spans([*map(len, parts)], limit, 1, 1, overlap)] or [paragraph]


def packed(parts: list[str], limit: int, least: int, overlap: int) -> list[str]:
    """Paragraphs packed greedily under the limit, in one pass over their sizes; see ``pack``."""
    out: list[str] = []
    for long, stretch in itertools.groupby(parts, key=lambda p: len(p) > limit):
        own = [*stretch]
        if long:
            out += itertools.chain.from_iterable(sentence_runs(p, limit, overlap) for p in own)
        else:
            out += ("\n\n".join(own[a:b]) for a, b in _spans([*map(len, own)], limit, 2))
    if len(out) > 1 and len(out[-1]) < least:
        out[-2:] = ["\n\n".join(out[-2:])]
    return out


def pack(parts: Column, limit: Column, least: int = LEAST, overlap: int = OVERLAP) -> Column:
    """Paragraphs packed greedily under the limit; a last scrap under ``least`` joins the chunk before it.

    A paragraph over the limit becomes runs of sentences; a sentence over it stays whole.
    Runs on Arrow batches: a fold over arrays copies what it made at every step.
    """

    @arrow_udf("array<string>")
    def run(texts: pa.Array, limits: pa.Array) -> pa.Array:
        made = [None if t is None else packed(t, n, least, overlap) for t, n in zip(texts.to_pylist(), limits.to_pylist())]
        return pa.array(made, pa.list_(pa.string()))

    return run(parts, limit)


def chunk_entries(entries: DataFrame, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP) -> DataFrame:
    """The chunks of dated entries; undated and blank ones give none (see ``undated``).

    The limit holds for the chunk with its header. Of an entry's warnings only
    reconstructed and no_captions pass on; split and oversize are added.
    """
    head = T.header(F.col("entry_date"), F.col("trip"))
    rows = entries.where(F.col("entry_date").isNotNull() & F.col("text").isNotNull()).withColumn("_head", head)
    rows = rows.withColumn("_bodies", pack(T.paragraphs(F.col("text")), F.greatest(F.lit(limit) - F.length("_head"), F.lit(200)), least, overlap))
    n, size = F.size("_bodies"), F.length("_head") + F.length("body")
    passed = F.filter(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: w.isin("reconstructed", "no_captions"))
    add = lambda c, w: F.when(c, F.array(F.lit(w))).otherwise(F.array().cast("array<string>"))
    # the outer form keeps the optimizer from evaluating the fold again for a filter on its size
    rows = rows.select("*", F.posexplode_outer("_bodies").alias("chunk_index", "body")).where(F.col("body").isNotNull())
    return rows.select(
        F.concat(F.col("id"), F.lit("/"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col("id").alias("entry_id"),
        F.concat("_head", "body").alias("text"),
        F.length("_head").alias("header_len"),
        "entry_date",
        F.substring("entry_date", 1, 4).try_cast("int").alias("year"),
        F.substring("entry_date", 6, 2).try_cast("int").alias("month"),
        "trip", "source_file", "chunk_index",
        n.alias("n_chunks"), size.alias("chars"),
        F.coalesce(F.size("photos"), F.lit(0)).alias("n_photos"),
        F.concat(passed, add(n > 1, "split"), add(size > limit, "oversize")).alias("warnings"),
    )


def undated(entries: DataFrame) -> DataFrame:
    """Entries that cannot become chunks for want of a date."""
    return entries.where(F.col("entry_date").isNull())
