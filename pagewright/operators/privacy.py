"""Lists of what identifies an archive, and the search of other texts for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagewright.functions import text as T
from pagewright.operators.retrieve import literal_counts

# Words too common to tell of a place, or of an episode.
GENERIC = (
    "pictures photos photo video videos misc other trip north south east west city town park island beach lake river bay old new "
    "house home road street market museum hotel temple church castle long nice region district central national royal great little "
    "upper lower grand high middle point cross well wells bath reading stirling sandwich"
).split()
ORDINARY = (
    "shows climbed married amount helped stayed gift dining glass broke change times place room went took time kind gave wrong lost "
    "flat tire bike shop phone travel someone restaurant hotel west"
).split()
MOST = 15


def names(places: DataFrame) -> DataFrame:
    """(value): names of trips and folders (column place), whole and by word, over three letters and not generic."""
    whole = places.select(F.lower(F.trim("place")).alias("value")).where("value <> '' AND NOT value rlike '^[0-9]{4}$'")
    words = whole.select(F.explode(F.split("value", r"[\s/_-]+")).alias("value"))
    return whole.unionByName(words).where(F.length("value") > 3).where(~F.col("value").isin(GENERIC)).distinct()


def dates(*sources: DataFrame) -> DataFrame:
    """(value): every entry date that any source knows."""
    out = None
    for s in sources:
        part = s.select(F.col("entry_date").alias("value")).where("value IS NOT NULL AND value <> ''")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


#: Values searched for in one pass over the texts: what travels with a task at once.
BLOCK = 20_000


def counts_in_blocks(texts: DataFrame, key: str, text: str, values: DataFrame, whole: bool = False) -> DataFrame:
    """(key, term, n) of all values, however many: gathered and searched for BLOCK at a time."""
    out, block = None, []

    def search(block: list[str]) -> DataFrame:
        found = literal_counts(texts, key, text, block, whole=whole)
        return found if out is None else out.unionByName(found)

    for row in values.select("value").distinct().toLocalIterator():
        block.append(row.value)
        if len(block) == BLOCK:
            out, block = search(block), []
    return search(block) if block or out is None else out


def _document_counts(entries: DataFrame, words: DataFrame) -> DataFrame:
    """(value, df): in how many entries each of the words of a question set stands."""
    held = counts_in_blocks(entries, "id", "text", words)
    return held.groupBy(F.col("term").alias("value")).agg(F.count_distinct("id").alias("df"))


def phrases(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """(kind, value): phrases and single words of questions (question, expected, says) that tell of an episode.

    Whole questions, pairs of neighbouring content words, sought-after strings in
    at most MOST entries, and content words in one to MOST. Questions about what
    never happened are left out.
    """
    real = questions.where(~T.is_absent(F.col("expected")) | F.col("expected").isNull())
    stop = F.array(*map(F.lit, T.STOP))
    tokens = F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9']+"), F.lit(0))
    content = lambda t: ~F.array_contains(stop, t) & (F.length(t) > 3)
    toks = real.select(F.lower(F.trim("question")).alias("question"), tokens.alias("t"), "says")
    pairs = F.filter(F.arrays_zip(F.col("t").alias("a"), F.slice("t", F.lit(2), F.size("t")).alias("b")), lambda p: p["b"].isNotNull() & content(p["a"]) & content(p["b"]))
    common = F.array(*map(F.lit, sorted({*GENERIC, *ORDINARY})))
    words = toks.select(F.explode(F.filter("t", lambda t: content(t) & ~F.array_contains(common, t))).alias("value")).distinct()
    said = toks.select(F.explode("says").alias("value")).select(F.lower(F.trim("value")).alias("value")).where(F.col("value") != "").where(~F.array_contains(common, F.col("value"))).distinct()
    counts = _document_counts(entries, words.unionByName(said))
    n = F.coalesce("df", F.lit(0))
    rare_words = words.join(counts, "value", "left").where(n.between(1, MOST)).select(F.lit("word").alias("kind"), "value")
    rare_said = said.join(counts, "value", "left").where(n <= MOST).select(F.when(F.contains("value", F.lit(" ")), "phrase").otherwise("word").alias("kind"), "value")
    long = toks.select("question").unionByName(toks.select(F.explode(F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"]))).alias("question")))
    told = long.select(F.lit("phrase").alias("kind"), F.col("question").alias("value"))
    every = told.unionByName(rare_said).unionByName(rare_words)
    return every.where((F.col("kind") == "word") | (F.length("value") > 8)).distinct()


def missing_upstream(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """Chunks whose entry is not among the entries; the key has another name on either side."""
    return chunks.join(entries.select(F.col("id").alias("entry_id")).distinct(), "entry_id", "left_anti")


def scan(texts: DataFrame, patterns: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, value): which patterns (kind, value) stand in which texts.

    Names and words match whole, phrases anywhere, dates not inside longer
    numbers or time stamps. Days are joined; names, words and phrases are searched for
    in blocks of BLOCK, each one pass over the texts.
    """
    whole = counts_in_blocks(texts, key, text, patterns.where(F.col("kind").isin("name", "word")), whole=True)
    within = counts_in_blocks(texts, key, text, patterns.where("kind = 'phrase'"))
    found = whole.unionByName(within).select(key, F.col("term").alias("value"))
    day = r"(?<!\d)\d{4}-\d{2}-\d{2}(?![\dT])"
    days = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(day), F.lit(0)))).alias("value"))
    kinds = patterns.select("kind", "value").distinct()
    return (
        found.join(kinds.where("kind <> 'date'"), "value").unionByName(days.join(kinds.where("kind = 'date'"), "value")).select(key, "kind", "value").distinct()
    )


# Suffixes and folders of archive content and of what is derived from it, and the largest size.
BLOCKED_SUFFIXES = "doc docx rtf odt pages pdf txt db sqlite sqlite3 lance parquet npy pkl jpg jpeg png heic mov mp4 jsonl".split()
BLOCKED_FOLDERS = "data journals journal-data index embeddings eval logs cache raw archive".split()
LARGEST = 5 * 1024 * 1024


def file_policy(files: DataFrame, most: int = LARGEST) -> DataFrame:
    """(path, reason) of files (path, size) that do not belong into a repository of code."""
    path = F.col("path")
    reason = (
        F.when(path.rlike(rf"(?i)\.({'|'.join(BLOCKED_SUFFIXES)})$"), "archive content")
        .when(path.rlike(rf"(^|/)({'|'.join(BLOCKED_FOLDERS)})/"), "archive folder")
        .when(path.rlike(r"\.ipynb$"), "notebook, may hold outputs")
        .when(F.col("size") > most, "large file")
    )
    return files.select("path", reason.alias("reason")).where("reason IS NOT NULL")
