"""Oversized texts cut into pieces at natural boundaries, with overlap.

Separators form a hierarchy: section, paragraph, sentence, word, character. A
span over the limit is cut at the coarsest boundary and only those of its parts
that are still over it are cut further. Neighbouring parts are then packed
greedily, each piece opening with the end of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LIMIT = 2000
OVERLAP = 200
LEVELS = ("section", "paragraph", "sentence", "word", "char")
#: Where the next part begins, by level: the end of each match.
CUTS = {
    "section": re.compile(r"\f\s*|\n[^\S\n]*\n(?:[^\S\n]*\n)+\s*(?=\S)|\n\s*(?=#{1,6} )|\n\s*(?:[-*_=]\s*){3,}\n\s*"),
    "paragraph": re.compile(r"\n[^\S\n]*\n\s*"),
    "sentence": re.compile(r"[.!?…؟।][\"'”’»)\]]*\s+|[。！？｡…]+[」』”’》）)\"]*\s*"),
    "word": re.compile(r"\s+"),
}


def _parts(text: str, start: int, end: int, level: str) -> list[tuple[int, int]]:
    at = [start]
    for m in CUTS[level].finditer(text, start, end):
        if m.end() > at[-1] and m.end() < end:
            at.append(m.end())
    return [*zip(at, [*at[1:], end])]


def _size(text: str, start: int, end: int) -> int:
    return len(text[start:end].strip())


def _atoms(text: str, start: int, end: int, level: int, limit: int, step: int) -> Iterator[tuple[int, int, int]]:
    """Spans within the limit, with the deepest level they needed."""
    if _size(text, start, end) <= limit:
        yield start, end, level
    elif LEVELS[level] == "char":
        start += len(text[start:end]) - len(text[start:end].lstrip())
        for k in range(start, end, step):
            yield k, min(k + step, end), level
    else:
        for a, b in _parts(text, start, end, LEVELS[level]):
            if _size(text, a, b) <= limit:
                yield a, b, level
            else:
                yield from _atoms(text, a, b, level + 1, limit, step)


def _back(text: str, floor: int, end: int) -> int:
    """Start of the overlap: the first sentence, else word, that begins in text[floor:end]."""
    for level in ("sentence", "word"):
        m = CUTS[level].search(text, max(floor - 1, 0), end)
        if m and m.end() < end:
            return m.end()
    return floor


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int]], str | None]:
    """((start, end, overlap) of each piece, coarsest level that brings every part within the limit)."""
    if len(text) <= limit:
        return ([(0, len(text), 0)] if text.strip() else []), None
    out: list[tuple[int, int, int]] = []
    deepest, begin, last, shared = 0, None, 0, 0
    for a, b, level in _atoms(text, 0, len(text), 0, limit, max(limit - overlap, 1)):
        deepest = max(deepest, level)
        body = a + len(text[a:b].rstrip())
        if body == a:
            continue
        if begin is not None and _size(text, begin, body) > limit:
            out.append((begin, last, shared))
            room = limit - (body - last)
            floor = max(last - min(overlap, room), begin + 1)
            begin = _back(text, floor, last) if room > 0 and overlap and floor < last else a
            shared = max(last - begin, 0)
        elif begin is None:
            begin = a + len(text[a:b]) - len(text[a:b].lstrip())
        last = body
    if begin is not None:
        out.append((begin, last, shared))
    return out, LEVELS[deepest] if len(out) > 1 else None


def split_oversized(
    df: DataFrame, key: str, text: str, *, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True
) -> DataFrame:
    """(key, chunk_index, start_char, end_char, overlap_chars, cut_at[, text]): the pieces of every text.

    Every piece holds at most ``limit`` code points. A piece after the first
    opens with up to ``overlap`` characters of the end of the one before it, from
    a sentence or word start; ``overlap_chars`` states how many, fewer where a
    paragraph leaves less room. ``cut_at`` is the finest level the text needed.
    A text within the limit is one piece with a null ``cut_at`` and never leaves
    the JVM. Null and blank texts give none; repeated rows give repeated pieces;
    other columns are ignored. A map without a shuffle.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").rlike(r"(?U)\S"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, index, start, end, shared, level, body = [], [], [], [], [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                found, cut = pieces(value, limit, overlap)
                for k, (a, b, o) in enumerate(found):
                    parent.append(row)
                    index.append(k)
                    start.append(a)
                    end.append(b)
                    shared.append(o)
                    level.append(cut)
                    if with_text:
                        body.append(value[a:b])
            columns = [batch.column(0).take(pa.array(parent, pa.int64())), *(pa.array(x, pa.int32()) for x in (index, start, end, shared)), pa.array(level, pa.string())]
            yield pa.RecordBatch.from_arrays(
                columns + ([pa.array(body, pa.string())] if with_text else []), names=[f"c{k}" for k in range(6 + with_text)]
            )

    names = ["chunk_index", "start_char", "end_char", "overlap_chars", "cut_at"] + ["text"] * with_text
    long = rows.where(F.length("text") > limit).mapInArrow(
        run, f"key {kind}, chunk_index int, start_char int, end_char int, overlap_chars int, cut_at string" + ", text string" * with_text
    )
    zero = F.lit(0)
    short = rows.where(F.length("text") <= limit).select(
        "key", *(c.alias(n) for c, n in zip((zero, zero, F.length("text"), zero, F.lit(None).cast("string"), F.col("text")), names))
    )
    return long.unionAll(short).withColumnRenamed("key", key)
