"""Evaluation passages found in training documents, re-parameterised ones included.

Both sides are canonicalised alike: markup, entities, wrongly decoded and invisible
characters, accents, case and punctuation go, and numbers, names and units are typed
by their shape in their own text, which makes templates. Windows of five words are
hashed on both sides: the words with the middle one left free, so that single
replaced words do not matter, and the template, its slots typed. The two tables of
windows are joined by hash in one pass over the documents, whatever the number of
items. What a document and an item share is then chained in order within a passage,
and the slots' fillings are compared: a mapping that sends equal fillings to equal
ones tells a re-parameterised copy from a chance likeness of templates.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pagewright.session import spread

WORDS = 5
SHARE = 0.5
#: Words of other sentences that may stand between two parts of a passage.
APART = 120
#: What each such word costs, in words held: far scattered stock phrases make no passage.
DISTANCE = 0.05
#: Parts that the documents' windows of one hash are spread over.
SALT = 4
#: Longs in the filter of the items' windows, at least and at most (32 MB).
FILTER = 1 << 12, 1 << 22
#: Distinct words that a task remembers the codes of, and words whose windows it makes at once.
MEMO, TOGETHER = 1 << 20, 1 << 18
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]+);")
_BREAK = re.compile(r"</?(?:br|p|div|li|td|tr|h\d)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_HIDDEN = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤﻿̀-ͯ]")
_MOJIBAKE = re.compile("(?:[Â-ô][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{1,3})+")
#: Scripts without blanks, of which every character is a word.
_SINGLE = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(rf"[{_SINGLE}]|[^\W_{_SINGLE}]+")
_IN_NUMBER = re.compile(r"(?<=\d)[.:,](?=\d)")
#: Words inside a sentence that are not in small Latin letters; the same with the word before.
_INNER = re.compile(r" (?<=[\w,;'’] )[\"“„«(]?((?![a-z])[^\W\d_][^\W_]*)")
_AFTER = re.compile(r"([^\W_]+)[,;'’]? [\"“„«(]?((?![a-z])[^\W\d_][^\W_]*)")
#: Before a common noun of a language that capitalises them: articles, endings of adjectives, merged prepositions.
_NOUN = re.compile(r"(?:e|en|er|es|em|as|ein|kein|mein|sein|im|am|zum|zur|vom|beim|ins|ans)$")
# Units and currencies that stand beside numbers.
UNITS = frozenset("km m cm mm kg g l ml min minutes hours days coins euros dollars pounds miles paces steps minuten stunden tage taler heures jours sous monedas minutos horas монет минут вёрст лет".split())
NUMBER, NAME, UNIT = 1, 2, 3
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _repaired(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except UnicodeError:
        return m[0]


def plain(text: str) -> str:
    """The text without markup, entities, wrongly decoded, invisible and combining characters; case is kept."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if "<" in text:
        text = _TAG.sub("", _BREAK.sub(" ", text))
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKD", _MOJIBAKE.sub(_repaired, text)))
    return _IN_NUMBER.sub("", text)


class Codes(dict):
    """A word's code: 30 bits of the hash of its lower-case form, and two of its type (names are told by their text)."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        low = word.lower()
        code = xxhash.xxh32_intdigest(low) & ~3 | (NUMBER if low[0].isdigit() else UNIT if low in UNITS else 0)
        self[word] = code
        return code


def names_in(text: str, said: set[str]) -> set[str]:
    """Words, as written, that are names by their shape: capitalised inside a sentence and never in lower case.

    Where capitals are common inside sentences (nouns of German), a word after an
    article or an adjective is none.
    """
    met = [w for w in _INNER.findall(text) if w[0].isupper()]
    if len(met) > 0.02 * len(text):
        met = [w for before, w in _AFTER.findall(text) if w[0].isupper() and not _NOUN.search(before)]
    found = {low for w in met if (low := w.lower()) not in said}
    return {w for w in said if w.lower() in found} if found else found


def coded(text: str, codes: Codes) -> np.ndarray:
    """The codes of a text's words."""
    shown = plain(text)
    words = _WORD.findall(shown)
    names = names_in(shown, set(words))
    out = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    if names:
        at = [k for k, w in enumerate(words) if w in names]
        out[at] |= np.where(out[at] & 3, 0, NAME)
    return out


def _mixed(parts: list[np.ndarray], seed: int) -> np.ndarray:
    out = np.full(len(parts[0]), seed, dtype=np.uint64)
    for p in parts:
        out = (out ^ p) * _GOLD
        out ^= out >> np.uint64(29)
    return out


def windows(codes: np.ndarray, short: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, length) of the windows: words with the middle one free, templates, and whole runs of the lengths ``short``.

    A template has a slot and at least two words that are none: tables of numbers have no template.
    """
    places, hashes, lengths = [], [], []
    literal = (codes >> 2).astype(np.uint64)
    n = len(codes) - WORDS + 1
    if n > 0:
        at = [literal[k : k + n] for k in range(WORDS)]
        places.append(np.arange(n))
        hashes.append(_mixed([a for k, a in enumerate(at) if k != WORDS // 2], 1))
        kind = codes & 3
        slots = np.add.reduce([(kind[k : k + n] > 0).astype(np.int8) for k in range(WORDS)])
        typed = np.where(kind > 0, kind, codes).astype(np.uint64)
        where = np.flatnonzero((slots > 0) & (slots <= WORDS - 2))
        places.append(where)
        hashes.append(_mixed([typed[k : k + n][where] for k in range(WORDS)], WORDS))
        lengths += [np.full(len(p), WORDS) for p in places]
    for size in short:
        n = len(codes) - size + 1
        if n > 0:
            places.append(np.arange(n))
            hashes.append(_mixed([literal[k : k + n] for k in range(size)], 16 + size))
            lengths.append(np.full(n, size))
    if not places:
        none = np.empty(0, np.int64)
        return none, none, none
    return np.concatenate(places), np.concatenate(hashes).view(np.int64), np.concatenate(lengths)


def chain(item: np.ndarray, hits: list[tuple]) -> tuple[float, float, bool]:
    """(share of the item's words held, share of its template held, slots filled consistently) of the best passage.

    ``hits`` are (place in the item, place in the document, the document's words there)
    of the shared windows. Windows on one diagonal form runs; runs are chained in
    order, at most APART words of the document apart. A slot's fillings are the words
    of its type; a word of another type is a replaced one and no part of the template.
    """
    doc: dict[int, int] = {}
    runs: list[list[int]] = []  # item start, item end, diagonal
    n = len(item)
    for d, p, said in sorted((at - place, place, said) for place, at, said in hits):
        last = runs[-1] if runs else None
        size = min(WORDS, n)
        doc.update(zip(range(p + d, p + d + size), said))
        if last and last[2] == d and p <= last[1]:
            last[1] = max(last[1], p + size)
        else:
            runs.append([p, p + size, d])
    runs.sort(key=lambda r: (r[0] + r[2], r[0]))
    said = [np.array([doc[k + d] for k in range(a, b)], dtype=np.int64) for a, b, d in runs]
    same = [(item[a:b] >> 2) == (w >> 2) for (a, b, _), w in zip(runs, said)]
    best: list[tuple[float, int, int]] = []  # score, words held, run before
    far: list[int] = []  # the furthest end in the document of the runs so far
    for k, (a, b, d) in enumerate(runs):
        own, before = int(same[k].sum()), (0.0, 0, -1)
        for j in range(k - 1, -1, -1):
            if far[j] < a + d - APART:
                break
            ja, jb, jd = runs[j]
            gap = a + d - (jb + jd)
            if ja < a and jb < b and ja + jd < a + d and jb + jd < b + d and gap <= APART:
                twice = int(same[k][: max(jb - a, -gap, 0)].sum())
                score = best[j][0] - twice - max(gap, 0) * DISTANCE
                if score > before[0]:
                    before = (score, best[j][1] - twice, j)
        best.append((own + before[0], own + before[1], before[2]))
        far.append(max(b + d, far[-1] if far else 0))
    if not best:
        return 0.0, 0.0, False
    k = max(range(len(best)), key=lambda j: best[j][0])
    held, alike, fillings, clash, seen, left_of = best[k][1], 0, {}, 0, n, None
    while k >= 0:
        a, b, d = runs[k]
        b = min(b, seen, b if left_of is None else left_of - d)
        if a < b:
            left, right = item[a:b], said[k][: b - a]
            kind = left & 3
            fits = (kind > 0) & (kind == (right & 3))
            alike += int((fits | same[k][: b - a]).sum())
            slots = fits & (kind != UNIT)
            for x, y in zip((left[slots] >> 2).tolist(), (right[slots] >> 2).tolist()):
                clash += fillings.setdefault(x, y) != y
            seen, left_of = a, a + d
        k = best[k][2]
    return held / n, alike / n, clash == 0


def _windows_of(rows: DataFrame, short: tuple[int, ...], bits: np.ndarray | None) -> DataFrame:
    """(key, at, h, w0 … w4): the windows of texts that pass the filter, with the words that stand there."""
    kind = rows.schema["key"].dataType.simpleString()

    def windows_in(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, hash, words there) of the windows of several texts that pass the filter, found in one go."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        words = np.concatenate([*texts, np.full(WORDS, -1, dtype=np.int64)])
        at, h, length = windows(words, short)
        text = np.searchsorted(starts, at, side="right") - 1
        keep = at + length <= (starts + sizes)[text]  # no window reaches into the next text
        if bits is not None:
            for probe in _probes(h, len(bits)):
                keep &= (bits[probe >> 6] >> (probe & 63)) & 1 == 1
        at, h, text = at[keep], h[keep], text[keep]
        said = words[np.minimum(at[:, None] + np.arange(WORDS), len(words) - 1)]
        return text, at - starts[text], h, said

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            texts, first, size = [], 0, 0
            every = batch.column(1).to_pylist()
            for k, text in enumerate(every):
                texts.append(coded(text, codes))
                size += len(texts[-1])
                if size >= TOGETHER or k + 1 == len(every):
                    row, place, hashed, said = windows_in(texts)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row + first)), pa.array(place.astype(np.int32)), pa.array(hashed), *(pa.array(said[:, j]) for j in range(WORDS))],
                        names=["key", "at", "h", *_SAID],
                    )
                    texts, first, size = [], k + 1, 0

    return rows.mapInArrow(run, f"key {kind}, at int, h long, " + ", ".join(f"{w} long" for w in _SAID))


def _covered(places: Column) -> Column:
    """Words that windows at these sorted places cover."""
    steps = F.zip_with(F.slice(places, 2, F.size(places)), F.slice(places, 1, F.size(places) - 1), lambda b, a: F.least(b - a, F.lit(WORDS)))
    return F.aggregate(steps, F.lit(WORDS), lambda n, step: n + step)


_SAID = [f"w{k}" for k in range(WORDS)]


def _probes(h: np.ndarray, longs: int) -> list[np.ndarray]:
    mask = longs * 64 - 1
    return [h & mask, (h >> 32) & mask]


def _filter_of(known: DataFrame, longs: int) -> np.ndarray:
    """A bit table of the windows' hashes; set bit by bit by Spark, of a fixed size whatever their number."""
    mask = longs * 64 - 1
    probe = F.explode(F.array(F.col("h").bitwiseAND(F.lit(mask)), F.shiftright("h", 32).bitwiseAND(F.lit(mask)))).alias("p")
    rows = known.select(probe).groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("b"))
    table = rows.toArrow()
    bits = np.zeros(longs, dtype=np.int64)
    bits[table["i"].to_numpy()] = table["b"].to_numpy()
    return bits


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, *, share: float = SHARE, salt: int = SALT) -> DataFrame:
    """(key, item_key, held, template_held, slots_consistent): documents holding items as passages.

    ``held`` is the share of the item's words that stand, in its order, in windows of
    five words of which at most the middle one differs; a pair comes out if that, or
    with consistently filled slots the template's share, is at least ``share`` (the
    caller tells the two apart). An item under five words is found as a whole. The
    join is by hash and ``salt``, so a window that a third of all rows hold is spread;
    what travels with tasks is a filter of at most 32 MB. Null and empty texts give
    none, repeated rows give one; other columns are ignored; a null key is kept.
    """
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    asked = items.select(F.col(item_key).alias("key"), F.col(item_text).alias("text")).where(F.length("text") > 0).distinct()
    read = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).where(F.length("text") > 0)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            rows = [coded(t, codes) for t in batch.column(1).to_pylist()]
            sizes = pa.array([len(r) for r in rows], pa.int32())
            texts = [xxhash.xxh64_intdigest(t.encode()) >> 1 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.int64()), sizes, pa.array(rows, pa.list_(pa.int64()))], names=["item", "version", "n", "codes"])

    canonical = asked.mapInArrow(code, f"item {kinds[1]}, version long, n int, codes array<long>").where("n > 0")
    sizes = canonical.agg(F.collect_set(F.when(F.col("n") < WORDS, F.col("n"))).alias("short"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    short = tuple(sorted(sizes.short))  # four lengths at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, hashed = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for k, words in enumerate(batch.column(2).to_pylist()):
                at, h, _ = windows(np.array(words, dtype=np.int64), (len(words),) if len(words) < WORDS else ())
                row.append(np.full(len(h), k))
                place.append(at)
                hashed.append(h)
            index = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), pa.array(np.concatenate(place).astype(np.int32)), pa.array(np.concatenate(hashed))],
                names=["item", "version", "place", "h"],
            )

    known = canonical.select("item", "version", "codes").mapInArrow(cut, f"item {kinds[1]}, version long, place int, h long")
    longs = FILTER[0]
    while longs < FILTER[1] and longs < sizes.words:
        longs *= 2
    part = F.pmod(F.xxhash64("key", "at"), F.lit(salt)).cast("int")
    hits = _windows_of(read, short, _filter_of(known, longs)).withColumn("salt", part)
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    pairs = (
        hits.join(known, ["h", "salt"])
        .groupBy("key", "item", "version")
        .agg(F.collect_set(F.struct("place", "at", *_SAID)).alias("hits"))
        .join(canonical.withColumnsRenamed({"item": "its", "version": "own"}), F.equal_null("item", "its") & (F.col("version") == F.col("own")))
        # no more of the item than its windows cover can be held
        .withColumn("places", F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["place"]))))
        .where(_covered(F.col("places")) >= F.lit(share) * F.col("n"))
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [
                chain(np.array(words, dtype=np.int64), [(h["place"], h["at"], [h[w] for w in _SAID]) for h in hits])
                for hits, words in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            held, alike, steady = [*zip(*said)] or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(held, pa.float64()), pa.array(alike, pa.float64()), pa.array(steady, pa.bool_())],
                names=["key", "item", "held", "template_held", "slots_consistent"],
            )

    found = pairs.select("key", "item", "hits", "codes").mapInArrow(judge, f"key {kinds[0]}, item {kinds[1]}, held double, template_held double, slots_consistent boolean")
    kept = found.where((F.col("held") >= share) | (F.col("slots_consistent") & (F.col("template_held") >= share)))
    return kept.withColumnsRenamed({"key": key, "item": item_key})
