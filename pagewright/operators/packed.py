"""Several values packed in one field: one row per value, position kept.

The scan works on whole Arrow batches. The batch's string buffer becomes one
array of code points; delimiter, blank, escape and quote masks are vectorised
over it, quoted spans are found by matching opener and closer positions, child
offsets follow from the surviving delimiters, and the values are built as an
Arrow list array that is flattened with its parent ordinals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

DELIMITERS = ",;|\n\t\r；、•，｜"
#: Opening quote -> the marks that may close it.
QUOTES = {'"': '"”', "'": "'’", "“": "”\"", "„": "“”\"", "«": "»", "‘": "’'", "「": "」", "‹": "›"}
BRACKETS = "[](){}"


def _mask(chars: np.ndarray, members: str) -> np.ndarray:
    return np.isin(chars, np.array([ord(c) for c in members], dtype=np.uint32))


def _blank(chars: np.ndarray) -> np.ndarray:
    return (chars <= 32) | _mask(chars, " 　​﻿    ")


def _nearest(flag: np.ndarray, forward: bool) -> np.ndarray:
    """Index of the nearest flagged position at or after (before) each position; the size (or -1) where none."""
    n = len(flag)
    at = np.arange(n)
    if forward:
        return np.minimum.accumulate(np.where(flag, at, n)[::-1])[::-1]
    return np.maximum.accumulate(np.where(flag, at, -1))


def _spans(chars, start, end, stop, blank, quote_ok):
    """Quoted spans (open, close) that do not overlap, over all rows at once.

    An opener stands at the start of a value (after a delimiter, a bracket or
    the start of the field); its closer is the first fitting mark that is
    followed by a delimiter, a bracket or the end of the field and, for straight
    double quotes, ends a run of odd length (a doubled quote is a literal one).
    """
    n = len(chars)
    solid = ~blank | stop
    before = np.empty(n, dtype=np.int64)
    before[0:1] = -1
    before[1:] = _nearest(solid, False)[:-1]
    after = np.full(n, n, dtype=np.int64)
    after[:-1] = _nearest(solid, True)[1:]
    opens_at = (before < start) | stop[np.maximum(before, 0)]
    ends_at = (after >= end) | stop[np.minimum(after, n - 1)]
    straight = (chars == ord('"')) & quote_ok
    run_start = np.maximum.accumulate(np.where(straight & ~np.r_[False, straight[:-1]], np.arange(n), -1))
    odd = (np.arange(n) - run_start) % 2 == 0
    pairs = []
    for opener, closers in QUOTES.items():
        o = np.flatnonzero((chars == ord(opener)) & opens_at & quote_ok)
        closing = _mask(chars, closers) & ends_at & quote_ok
        if opener == '"':
            closing &= (chars != ord('"')) | odd
        c = np.flatnonzero(closing)
        if not len(o) or not len(c):
            continue
        k = np.searchsorted(c, o, side="right")
        ok = k < len(c)
        o, shut = o[ok], c[k[ok]]
        ok = shut < end[o]
        pairs.append(np.stack([o[ok], shut[ok]]))
    if not pairs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    o, c = np.concatenate(pairs, axis=1)
    order = np.argsort(o, kind="stable")
    o, c = o[order], c[order]
    nxt = np.searchsorted(o, c, side="right")  # the first opener past the closer
    row = start[o]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    keep = np.zeros(len(o), dtype=bool)
    while len(first):  # one step per quoted value of the longest field, for all rows together
        keep[first] = True
        ahead = nxt[first]
        ok = ahead < len(o)
        first, ahead = first[ok], ahead[ok]
        first = ahead[row[ahead] == row[first]]
    return o[keep], c[keep]


def split_packed(fields: pa.Array, tokens: bool = False) -> pa.ListArray:
    """Lists of the values of each field.

    ``tokens``: the values hold no blanks, so blanks, quotes, brackets, a slash
    between blanks and the word ``or`` part them as well.
    Null and blank fields give empty lists. A quote without a partner and a
    quote inside a value are ordinary characters.
    """
    fields = pc.fill_null(fields.cast(pa.large_string()), "")
    lengths = pc.utf8_length(fields).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = len(lengths)
    ends = np.cumsum(lengths)
    chars = _code_points(fields)
    n = len(chars)
    if not n:
        return pa.ListArray.from_arrays(pa.array(np.zeros(rows + 1, np.int32)), pa.array([], pa.string()))
    of = np.repeat(np.arange(rows), lengths)
    start, end = (ends - lengths)[of], ends[of]
    blank = _blank(chars)
    delimiter = _mask(chars, DELIMITERS)
    drop = np.zeros(n, dtype=bool)
    if tokens:
        delimiter |= blank | _mask(chars, BRACKETS) | _mask(chars, "".join(QUOTES) + "".join(QUOTES.values()) + "\\")
        drop |= delimiter
    else:
        slash = chars == ord("\\")
        run = np.arange(n) - np.maximum.accumulate(np.where(slash & ~(np.r_[False, slash[:-1]] & (np.arange(n) != start)), np.arange(n), -1))
        escapes = slash & (run % 2 == 0) & (np.arange(n) + 1 < end)
        special = delimiter | _mask(chars, "".join(QUOTES) + "".join(QUOTES.values()) + "\\")
        escapes &= np.r_[special[1:], False]
        escaped = np.r_[False, escapes[:-1]]
        drop |= escapes
        solid = ~blank
        lead = np.minimum(_nearest(solid, True), n - 1)[np.minimum(ends - lengths, n - 1)]
        tail = np.maximum(_nearest(solid, False), 0)[np.maximum(ends - 1, 0)]
        listed = (lengths > 1) & (chars[lead] == ord("[")) & (chars[tail] == ord("]")) & (lead < tail)
        bracket = np.zeros(n, dtype=bool)
        bracket[lead[listed]] = True
        bracket[tail[listed]] = True
        stop = (delimiter & ~escaped) | bracket
        opened, closed = _spans(chars, start, end, stop, blank, ~escaped)
        depth = np.zeros(n + 1, dtype=np.int32)
        np.add.at(depth, opened, 1)
        np.add.at(depth, closed + 1, -1)
        inside = np.cumsum(depth[:-1]) > 0
        delimiter = stop & ~inside
        drop |= delimiter
        drop[opened] = drop[closed] = True
        # a doubled straight quote inside straight quotes stands for one
        wrapped = np.zeros(n + 1, dtype=np.int32)
        by_straight = chars[opened] == ord('"')
        np.add.at(wrapped, opened[by_straight] + 1, 1)
        np.add.at(wrapped, closed[by_straight], -1)
        straight = (chars == ord('"')) & (np.cumsum(wrapped[:-1]) > 0) & ~escaped
        first = straight & ~np.r_[False, straight[:-1]]
        place = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), -1))
        drop |= straight & np.r_[straight[1:], False] & (place % 2 == 0)
    token = np.cumsum(delimiter | np.r_[True, of[1:] != of[:-1]])
    # outer blanks: those with no solid character before, or none after, in their value
    solid = ~blank & ~drop
    last = np.flatnonzero(np.r_[token[1:] != token[:-1], True])
    first = np.r_[0, last[:-1] + 1]
    seen = np.cumsum(solid)
    begin = np.repeat(seen[first] - solid[first], last - first + 1)
    total = np.repeat(seen[last], last - first + 1)
    keep = ~drop & (seen > begin) & (seen - solid < total)
    size = np.add.reduceat(keep.astype(np.int64), first)
    parent = of[first]
    values = _strings(chars[keep], size[size > 0])
    parent = parent[size > 0]
    if tokens:
        ok = ~pc.is_in(pc.utf8_lower(values), pa.array(["or", "and", "/", "-"])).to_numpy(zero_copy_only=False)
        values, parent = values.filter(pa.array(ok)), parent[ok]
    offsets = np.searchsorted(parent, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _code_points(fields: pa.LargeStringArray) -> np.ndarray:
    """The code points of all fields, one after another, from the UTF-8 buffer of the array.

    A code point is where a byte does not continue one; its bits are put together from
    the lead byte and the continuations behind it, all of a width at once.
    """
    fields = fields.combine_chunks() if isinstance(fields, pa.ChunkedArray) else fields
    _, offsets, data = fields.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[fields.offset : fields.offset + len(fields) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    leads = np.flatnonzero((raw & 0xC0) != 0x80)
    first = raw[leads].astype(np.uint32)
    chars = first.copy()
    for width, mask, low in ((2, 0x1F, 0xC0), (3, 0x0F, 0xE0), (4, 0x07, 0xF0)):
        at = np.flatnonzero((first >= low) & (first < (0xE0, 0xF0, 0x100)[width - 2]))
        value = first[at] & mask
        for k in range(1, width):
            value = value << 6 | (raw[leads[at] + k] & 0x3F)
        chars[at] = value
    return chars


def _strings(chars: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow string array over the code points, cut by sizes."""
    data = chars.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    width = 1 + (chars > 0x7F).astype(np.int32) + (chars > 0x7FF) + (chars > 0xFFFF)
    offsets = np.r_[0, np.cumsum(width)][np.r_[0, np.cumsum(sizes)]].astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def unpack_values(df: DataFrame, key: str, field: str, *, tokens: bool = False, opening: str | None = None) -> DataFrame:
    """(key, pos, value): every value of ``field``, pos counting the non-empty ones from 1.

    A map over Arrow batches, without a shuffle; rows stay where they are, so a
    hot key is no burden. ``opening`` is a word dropped where it opens a field.
    Null, empty and blank fields give no row; repeated rows give repeated rows;
    other columns of ``df`` are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            if opening:
                texts = pc.replace_substring_regex(texts, rf"(?i)^\s*{opening}\b\s*:?", "")
            lists = split_packed(texts, tokens)
            parent = pc.list_parent_indices(lists)
            owner = parent.to_numpy(zero_copy_only=False)
            starts = lists.offsets.to_numpy(zero_copy_only=False)
            pos = np.arange(len(owner)) - starts[owner] + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(parent), pa.array(pos.astype(np.int32)), lists.flatten().cast(pa.string())],
                names=["key", "pos", "value"],
            )

    return df.select(F.col(key).alias("key"), F.col(field).cast("string").alias("field")).where(
        F.col("field").isNotNull()
    ).mapInArrow(run, f"key {kind}, pos int, value string").withColumnRenamed("key", key)
