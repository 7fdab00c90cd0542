import random

import pytest

from pagewright.llm.splitting import pieces, split_oversized


def check(text, limit, overlap):
    found, cut = pieces(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b, _ in found)
    covered = 0
    for k, (a, b, o) in enumerate(found):
        assert text[covered:a].strip() == "" if a > covered else True
        assert o == (max(found[k - 1][1] - a, 0) if k else 0) and o <= overlap
        covered = max(covered, b)
    assert text[covered:].strip() == ""
    return found, cut


@pytest.mark.parametrize(
    "text, cut",
    [
        ("a. " * 500 + "\n\n" + "b. " * 500, "paragraph"),
        ("One two three. " * 300, "sentence"),
        ("one two three " * 300, "word"),
        ("x" * 4100, "char"),
        ("雨が降った。" * 500, "sentence"),
        ("a" * 1999 + " \n \t\n" + "b" * 10, "paragraph"),
        ("a" * 2000, None),
    ],
)
def test_levels(text, cut):
    assert check(text, 2000, 200)[1] == cut


def test_random_texts_keep_everything_within_the_limit():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b c ", ". ", "\n", "\n\n", "。", "xyz" * 9, " \n \n"]) for _ in range(rng.randint(1, 200)))
        check(text, rng.randint(20, 80), rng.choice([0, 5, 15]))


def test_overlap_repeats_the_end():
    text = "One two three. " * 300
    found, _ = pieces(text, 2000, 200)
    assert all(150 <= o <= 200 for _, _, o in found[1:])


def test_rows(spark):
    df = spark.createDataFrame([("a", "x" * 4100, 1), ("a", "x" * 4100, 1), ("b", "", 2), ("c", None, 3), ("d", "short", 4)], "id string, text string, chunk_index int")
    rows = split_oversized(df, "id", "text").orderBy("id", "chunk_index").collect()
    assert [r.id for r in rows] == ["a"] * 6 + ["d"]
    assert all(len(r.text) <= 2000 for r in rows)
    assert split_oversized(df.limit(0), "id", "text").count() == 0
