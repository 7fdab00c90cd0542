"""Cleaning, tokens, hashes and tests of text, as column expressions.

Only what Spark has no function for runs in Python, on Arrow batches: Unicode
folding, quoted lists and positional snippets.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# Media suffixes; words left out of queries; words that are capitalised without being names.
MEDIA = ["avi", "gif", "heic", "heif", "jpeg", "jpg", "m4v", "mov", "mp4", "png", "tif", "tiff"]
STOP = (
    "a an the and or of in on at to for with i we my our it that this was were is are be been had have has did do does "
    "from by as but so then there here when where what which who how why all any some more most other into over under "
    "about after before during while than too very just only also not no nor"
).split()
NOT_A_NAME = (
    "the a an i we he she they it this that there then after before when while also but and at in on by my his her our "
    "their author monday tuesday wednesday thursday friday saturday sunday january february march april may june july "
    "august september october november december"
).split()
# Phrases by which an answer is known as a refusal.
REFUSING = [
    "can't find that in the journals",
    "cant find that in the journals",
    "not in the journals",
    "do not appear",
    "does not appear",
    "do not contain",
    "does not contain",
    "no mention",
]
REFUSAL = f"(?i){'|'.join(REFUSING)}"
SENTENCE = r"(?<=[.!?])\s+"
WORD = r"[\p{L}\p{N}_']+"

# How names begin that cameras give.
CAMERA_NAMES = ["IMG", "DSC", "DSCN", "PXL", "VID", "MVI", "P[0-9]", "GOPR", "SAM", "PICT"]

_media = "|".join(MEDIA)
# a reference begins with its run of text: after a bracket, a line's start or the reference before it
_begin = r"(?:\(|(?<![^()\n])|\G)"
#: A media file's path: anything on its line but brackets, up to a suffix.
_path = rf"[^()\n]*?\.(?:{_media})"
#: One path or several between commas, in brackets or not.
PHOTO_REF = rf"(?i)\(?\s*{_path}(?:\s*,\s*{_path})*\s*\)?"


def strip_photo_refs(text: Column) -> Column:
    """struct(text, refs): the text without references to media files, and those."""
    anchored = PHOTO_REF.replace(r"\(?\s*", _begin + r"\s*", 1)
    refs = F.regexp_extract_all(text, F.lit(anchored), F.lit(0))
    clean = F.regexp_replace(text, anchored, " ")
    clean = F.regexp_replace(F.regexp_replace(clean, r"\s*\(\s*\)", ""), r"\s+([,.;:!?])", "$1")
    return F.struct(clean.alias("text"), refs.alias("refs"))


def normalise(text: Column) -> Column:
    """Blanks collapsed in lines, blank lines to one, outer blanks gone."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def normalise_path(target: Column) -> Column:
    """The last three parts of a link target, unquoted, without drive, scheme and dots."""
    plain = F.coalesce(F.try_url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), target)
    parts = F.split(F.regexp_replace(plain, r"file:///?(?=[^/]|/|$)|file://", ""), r"[\\/]+")
    kept = F.filter(parts, lambda p: (p != "") & ~p.isin("..", ".") & ~F.endswith(p, F.lit(":")))
    return F.array_join(F.slice(kept, F.greatest(F.size(kept) - 2, F.lit(1)), F.lit(3)), "/")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def caption(name: Column) -> Column:
    """A caption from a media file's name; null for names that cameras give."""
    stem = F.trim(F.regexp_replace(name, r"\.[^.]*$", ""))
    camera = rf"(?i)^(?:{'|'.join(CAMERA_NAMES)})(?:[-_ ]?[0-9]+)+$"
    stamp = "^[0-9]{8,}(?:[-_][0-9]+)?$"
    base = F.regexp_replace(F.regexp_replace(stem, r"[ _-]?\d+$", ""), "^[ _-]+|[ _-]+$", "")
    return F.when((stem != "") & ~stem.rlike(camera) & ~stem.rlike(stamp), F.nullif(base, F.lit("")))


def header(date: Column, trip: Column) -> Column:
    """What a chunk opens with: its day and trip."""
    name = F.trim(F.coalesce(trip, F.lit("")))
    return F.when(name == "", F.concat(date, F.lit(" — "))).otherwise(F.concat(date, F.lit(", "), name, F.lit(" — ")))


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\n\s*\n+"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def sentence_parts(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE), lambda s: F.trim(s) != "")


def content_hash(text: Column, model: str) -> Column:
    """The first 16 hex digits of the digest of model and text."""
    return F.substring(F.sha2(F.concat(F.lit(model + "\0"), text), 256), 1, 16)


def tokens(text: Column) -> Column:
    """Runs of letters, digits, underscores and apostrophes, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def content_words(query: Column, longer_than: int, years: bool = False) -> Column:
    """Tokens of a query that say something: no stop word, not short and, unless ``years``, no year."""
    stop = F.array(*map(F.lit, STOP))
    said = lambda t: ~F.array_contains(stop, t) & (F.length(t) > longer_than)
    if years:
        return F.filter(tokens(query), said)
    return F.filter(tokens(query), lambda t: said(t) & ~t.rlike("^19[89][0-9]$|^20[0-4][0-9]$"))


def is_short_query(query: Column) -> Column:
    """Whether a query is one or two content words, worth a literal lookup."""
    return F.size(content_words(query, 2, years=True)).between(1, 2)


def query_prompt(query: Column, instruction: str) -> Column:
    """The instruction stands before queries only; documents are embedded bare."""
    return F.concat(F.lit(f"Instruct: {instruction}\nQuery: "), query) if instruction else query


def similarity(distance: Column) -> Column:
    return 1 - distance * distance / 2


@pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def folded(text: Column, unicode_form: bool = True) -> Column:
    """Compatibility form, straight quotes and dashes, single blanks, lower case."""
    base = _nfkc(text) if unicode_form else text
    return F.lower(F.trim(F.regexp_replace(F.translate(base, "‘’“”–—", "''\"\"--"), r"(?U)\s+", " ")))


def names_in(text: Column) -> Column:
    """Capitalised words, in lower case, that do not open a sentence; sorted and distinct."""
    words = F.transform(F.split(text, SENTENCE), lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0)))
    inner = F.flatten(F.transform(words, lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))))
    known = F.array(*map(F.lit, NOT_A_NAME))
    capital = F.filter(inner, lambda w: w.rlike(r"^\p{Lu}") & ~F.array_contains(known, F.lower(w)))
    return F.array_sort(F.array_distinct(F.transform(capital, lambda w: F.lower(w))))


def is_refusal(answer: Column) -> Column:
    return answer.rlike(REFUSAL)


def citations(answer: Column) -> Column:
    """The ISO dates of an answer, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0))))


def is_absent(expected: Column) -> Column:
    return (F.size(expected) == 1) & (F.upper(expected[0]) == "NONE")


def matched(expected: Column, date: Column, entry: Column, chunk: Column) -> Column:
    """The first expected value that names a hit by date, entry or chunk; null for absent questions."""
    return F.when(~is_absent(expected), F.try_element_at(F.filter(expected, lambda e: (e == date) | (e == entry) | (e == chunk)), F.lit(1)))


def reply_statements(reply: Column) -> Column:
    """Lines of a model's reply that are JSON objects with a statement."""
    lines = F.transform(F.split(reply, "\n"), lambda x: F.regexp_replace(x, r"^[\s,`]+|[\s,`]+$", ""))
    read = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit("{"))), lambda x: F.from_json(x, "statement string, evidence string"))
    return F.filter(read, lambda s: s["statement"].isNotNull())


def shell_command(text: Column) -> Column:
    """The command of a message that wraps one; null otherwise."""
    pattern = r"(?s)^<bash-input>(.*?)</bash-input>"
    return F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1)))


def image_fault(content: Column) -> Column:
    """What is wrong with a file that should be an image, by size and first bytes; null for a whole JPEG or PNG."""
    head, tail, size = F.hex(F.substring(content, 1, 8)), F.hex(F.substring(content, -2, 2)), F.length(content)
    whole = (F.startswith(head, F.lit("FFD8")) & (tail == "FFD9")) | (head == "89504E470D0A1A0A") | F.startswith(head, F.lit("474946"))
    return (
        F.when(size == 0, "zero-length")
        .when(F.startswith(head, F.lit("000000")), "zero-filled")
        .when(whole, F.lit(None).cast("string"))
        .when(F.startswith(head, F.lit("FFD8")), "valid JPEG header, truncated or damaged body")
        .otherwise("not an image (wrong magic bytes)")
    )


@pandas_udf(ArrayType(StringType()))
def quoted_list(field: pd.Series) -> pd.Series:
    """Values between commas, where double quotes, straight or curly, protect commas."""
    from pagewright.operators.packed import split_packed

    import pyarrow as pa

    guard = str.maketrans({"“": '"', "”": '"', ";": "\ue000", "|": "\ue001"})
    straight = field.map(lambda s: None if s is None else s.translate(guard))
    lists = split_packed(pa.array(straight, pa.string())).to_pylist()
    back = str.maketrans({"\ue000": ";", "\ue001": "|"})
    return pd.Series([[v.translate(back) for v in values] for values in lists], index=field.index)


def snippet(width: int):
    """A function of (text, header length, query): the window of ``width`` with most query words near."""
    stop = frozenset(STOP)

    def window(flat: str, query: str) -> str:
        stems = [w[:6] for w in re.findall(r"[a-z']{3,}", query.lower()) if w not in stop]
        at = sorted(m.start() for w in stems for m in re.finditer(rf"\b{re.escape(w)}", flat, re.I)) if len(flat) > width else []
        if not at:
            return flat[:width]
        crowd = [sum(abs(x - h) <= width // 2 for x in at) for h in at]
        start = max(0, at[crowd.index(max(crowd))] - width // 3)
        blank = flat.find(" ", start) if start else -1
        start = blank + 1 if 0 <= blank < start + 25 else start
        out = flat[start : start + width]
        end = out.rfind(" ")
        return ("…" if start else "") + (out[:end] if start + width < len(flat) and end > width - 25 else out)

    @pandas_udf(StringType())
    def run(text: pd.Series, skip: pd.Series, query: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else window(" ".join(t[int(k or 0) :].split()), q or "") for t, k, q in zip(text, skip, query)], index=text.index)

    return run
