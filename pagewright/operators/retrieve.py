"""Retrieval for many questions in one plan: filters, vectors, keywords, literal terms, fusion, reserved slots.

Questions come as rows (q, query[, qv, year, trip]); hits go out as rows
(q, chunk_id, ..., rank). Questions are a stated query set, gathered in blocks
of BLOCK; everything else stays distributed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pagewright.functions import dates as D, text as T
from pagewright.operators import index as I

BLOCK = 1024
K1, B = 1.2, 0.75
RRF = 60
RARE_ENTRIES, RARE_TERMS, RARE_EPS, RARE_SLACK = 10, 8, 0.005, 1


def narrowed(chunks: DataFrame, year: int | None = None, trip: str | None = None) -> DataFrame:
    """Chunks of a year and trip, where given; applied before any ranking."""
    if year:
        chunks = chunks.where(F.col("year") == year)
    return chunks.where(F.col("trip") == trip) if trip else chunks


def top(df: DataFrame, k: int, *order: Column, by: str = "q") -> DataFrame:
    """The first k rows of each question, ranked; the limit is applied before the shuffle as well."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def nearest(index: DataFrame, questions: DataFrame, k: int, dim: int, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """(q, key, distance, rank): the k nearest rows of the index to each question's qv, exactly.

    Distance is the Euclidean one of vectors scaled to length one. Vectors that
    are missing, of another length, zero or with NaN take no part.
    """
    kinds = questions.schema["q"].dataType.simpleString(), index.schema[key].dataType.simpleString()
    asked = questions.where((F.size("qv") == dim) & ~F.exists("qv", lambda x: F.isnan(x) | x.isNull())).select("q", "qv")
    rows = index.where(F.size(vector) == dim).select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v"))
    blocks: list[list] = [[]]
    for r in asked.toLocalIterator():
        if len(blocks[-1]) == BLOCK:
            blocks.append([])
        blocks[-1].append(r)

    def over(block: list) -> DataFrame:
        ids = [r.q for r in block]
        q = np.array([r.qv for r in block], dtype=np.float64).reshape(-1, dim)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                norm = np.linalg.norm(v, axis=1)
                good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
                if not len(good) or not len(q):
                    continue
                like = q @ (v[good] / norm[good, None]).T
                n = min(k, len(good))
                # all rows at the n-th place's likeness, so that ties are settled by key later
                least = np.partition(like, like.shape[1] - n, axis=1)[:, like.shape[1] - n]
                row, col = np.nonzero(like >= least[:, None] - 1e-12)
                d = np.sqrt(np.maximum(0.0, 2 - 2 * like[row, col]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in row]), batch.column(0).take(pa.array(good[col])), pa.array(d)], names=["q", "key", "distance"]
                )

        return rows.mapInArrow(run, f"q {kinds[0]}, key {kinds[1]}, distance double")

    found = over(blocks[0])
    for block in blocks[1:]:
        found = found.unionAll(over(block))
    return top(found, k, F.round("distance", 9), F.col("key")).withColumnRenamed("key", key)


def keyword(chunks: DataFrame, questions: DataFrame, k: int, stored: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(q, chunk_id, score, rank): the k best chunks by BM25; a question of stop words only has none.

    Only the questions' terms of the postings are joined; N and the mean length
    are one row. With ``stored``, an index of ``index.read_keyword_index``, the chunks'
    texts are not read: of the postings only the buckets of the terms are, and those of
    ``chunks`` kept.
    """
    stop = F.array(*map(F.lit, T.STOP))
    terms = questions.select("q", F.explode(F.array_distinct(F.filter(T.tokens(F.col("query")), lambda t: ~F.array_contains(stop, t)))).alias("term"))
    if stored is None:
        # one pass: every chunk's tokens give its length and the counts of the terms asked for
        tokens = chunks.select("chunk_id", T.tokens(F.col("text")).alias("toks"))
        whole = tokens.agg(F.count("*").alias("n"), F.avg(F.size("toks")).alias("mean"))
        asked = tokens.select("chunk_id", F.size("toks").alias("len"), F.explode("toks").alias("term"))
        asked = asked.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term", "chunk_id", "len").agg(F.count("*").alias("tf"))
        df = asked.groupBy("term").agg(F.count("*").alias("df"))
    else:
        postings, whole = stored
        buckets = terms.select("term", F.pmod(F.xxhash64("term"), F.lit(I.BUCKETS)).cast("int").alias("bucket")).distinct()
        asked = postings.join(buckets, ["bucket", "term"], "left_semi").drop("bucket")
        df = asked.groupBy("term").agg(F.count("*").alias("df"))  # over the whole index, as the scores are
        asked = asked.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    scored = asked.join(df, "term").join(F.broadcast(whole))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    hits = scored.select("term", "chunk_id", weight.alias("w")).join(terms, "term").groupBy("q", "chunk_id").agg(F.round(F.sum("w"), 9).alias("score"))
    return top(hits, k, F.col("score").desc(), F.col("chunk_id"))


def lookup(chunks: DataFrame, term: str, whole: bool = True) -> DataFrame:
    """Every chunk that holds the term, with its count; unranked and without a limit, by date and place.

    Case does not matter; per cent and underscore are ordinary characters. A
    blank term finds nothing.
    """
    needle = term.strip().lower()
    if not needle:
        return chunks.withColumn("count", F.lit(0).cast("bigint")).where(F.lit(False))
    quoted = "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in needle)
    pattern = rf"(?iuU)(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])" if whole else rf"(?iu){quoted}"
    found = chunks.where(F.contains(F.lower("text"), F.lit(needle)))
    if whole:
        found = found.where(F.col("text").rlike(pattern))
    return found.withColumn("count", F.regexp_count("text", F.lit(pattern)).cast("bigint")).orderBy("entry_date", "chunk_index", "chunk_id")


def literal_counts(df: DataFrame, key: str, text: str, terms: list[str], whole: bool = False) -> DataFrame:
    """(key, term, n): how often each of ``terms`` (lower case) stands in each text, all in one pass over the texts."""
    kind = df.schema[key].dataType.simpleString()
    wanted = sorted({t for t in terms if t})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for t in wanted:
                machine.add_word(t, t)
            machine.make_automaton()
            ends = lambda s: machine.iter(s)
        except ImportError:
            finder = re.compile("(?=(" + "|".join(sorted(map(re.escape, wanted), key=len, reverse=True)) + "))")

            def ends(s: str) -> Iterator[tuple[int, str]]:
                for m in finder.finditer(s):
                    for t in wanted:
                        if s.startswith(t, m.start()):
                            yield m.start() + len(t) - 1, t

        for batch in batches:
            rows, found, number = [], [], []
            for k, s in enumerate(batch.column(1).to_pylist()):
                seen: dict[str, list[int]] = {}
                for end, t in ends(s):
                    start = end - len(t) + 1
                    if whole and ((start and (s[start - 1].isalnum() or s[start - 1] == "_")) or (end + 1 < len(s) and (s[end + 1].isalnum() or s[end + 1] == "_"))):
                        continue
                    state = seen.setdefault(t, [0, -1])
                    if start > state[1]:
                        state[0] += 1
                        state[1] = end
                rows += [k] * len(seen)
                found += seen
                number += [n for n, _ in seen.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(number, pa.int64())], names=["key", "term", "n"])

    rows = df.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text")).where(F.length("text") > 0)
    if not wanted:
        rows = rows.where(F.lit(False))
    return rows.mapInArrow(run, f"key {kind}, term string, n bigint").withColumnRenamed("key", key)


def fuse(runs: list[tuple[DataFrame, float]], k: int) -> DataFrame:
    """(q, chunk_id, rrf, rank): reciprocal ranks summed over runs of (q, chunk_id, rank), earlier runs first in ties."""
    parts = [
        df.select("q", "chunk_id", (F.lit(w) / (RRF + F.col("rank"))).alias("s"), *(F.when(F.lit(j == i), F.col("rank")).alias(f"r{j}") for j in range(len(runs))))
        for i, (df, w) in enumerate(runs)
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    fused = whole.groupBy("q", "chunk_id").agg(F.round(F.sum("s"), 12).alias("rrf"), *(F.min(f"r{j}").alias(f"r{j}") for j in range(len(runs))))
    return top(fused, k, F.col("rrf").desc(), *(F.col(f"r{j}").asc_nulls_last() for j in range(len(runs))), F.col("chunk_id")).select("q", "chunk_id", "rrf", "rank")


def hybrid(chunks: DataFrame, questions: DataFrame, k: int, dim: int, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Vector and keyword runs of depth max(4k, 20), fused."""
    depth = max(4 * k, 20)
    return fuse([(nearest(chunks, questions, depth, dim), weights[0]), (keyword(chunks, questions, depth), weights[1])], k)


def query_terms(questions: DataFrame, limit: int = RARE_TERMS) -> DataFrame:
    """(q, pos, term): content words over three letters, then pairs of neighbouring ones, the first ``limit``."""
    words, toks = T.content_words(F.col("query"), 3), T.tokens(F.col("query"))
    pairs = F.filter(F.arrays_zip(toks.alias("a"), F.slice(toks, F.lit(2), F.size(toks)).alias("b")), lambda p: F.array_contains(words, p["a"]) & F.array_contains(words, p["b"]))
    terms = F.slice(F.concat(words, F.transform(pairs, lambda p: F.concat_ws(" ", p["a"], p["b"]))), 1, limit)
    return questions.select("q", F.posexplode(terms).alias("pos", "term"))


def _term_hits(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, chunk_id, n) of the terms of a stated query set."""
    return literal_counts(chunks, "chunk_id", "text", [r.term for r in terms.select("term").distinct().toLocalIterator()])


def rare_hits(chunks: DataFrame, questions: DataFrame, slots: int, dim: int) -> DataFrame:
    """(q, chunk_id, terms, count, sim, rank): chunks that hold rare terms of a question.

    Rare is a term in at most ten entries. Best are those with most rare terms,
    then nearest to qv; one chunk an entry; one more than ``slots`` where it ties.
    """
    terms = query_terms(questions).select("q", "term").distinct()
    held = _term_hits(chunks, terms).join(chunks.select("chunk_id", "entry_id"), "chunk_id")
    rare = held.groupBy("term").agg(F.count_distinct("entry_id").alias("df")).where(F.col("df") <= RARE_ENTRIES)
    found = (
        held.join(rare.select("term"), "term", "left_semi").join(terms, "term")
        .groupBy("q", "chunk_id", "entry_id").agg(F.count("*").alias("terms"), F.sum("n").alias("count"))
    )
    near = found.join(chunks.select("chunk_id", "vector"), "chunk_id").join(questions.select("q", "qv"), "q")
    near = near.withColumn("sim", F.round(cosine(F.col("qv"), F.col("vector"), dim), 9)).drop("vector", "qv")
    best = near.withColumn("of", F.row_number().over(W.partitionBy("q", "entry_id").orderBy(F.col("terms").desc(), F.col("sim").desc(), "chunk_id"))).where("of = 1")
    order = W.partitionBy("q").orderBy(F.col("terms").desc(), F.col("sim").desc(), "chunk_id")
    line = best.withColumns({"rank": F.row_number().over(order), "_t": F.lag("terms").over(order), "_s": F.lag("sim").over(order)})
    tie = (F.col("rank") == slots + RARE_SLACK) & (F.col("terms") == F.col("_t")) & (F.col("sim") >= F.col("_s") - RARE_EPS)
    return line.where((F.col("rank") <= slots) | tie).select("q", "chunk_id", "terms", "count", "sim", "rank")


def cosine(a: Column, b: Column, dim: int) -> Column:
    """Cosine of two arrays; 0 where one is missing, of another length, zero or with NaN."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when((F.size(a) == dim) & (F.size(b) == dim) & (norm > 0), dot(a, b) / norm)
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))


def with_slots(ranked: DataFrame, rare: DataFrame, k: int) -> DataFrame:
    """(q, chunk_id, rank, rare): the ranking, its last places given to rare hits it lacks."""
    missing = rare.join(ranked.select("q", "chunk_id"), ["q", "chunk_id"], "left_anti").select("q", "chunk_id", "rank")
    number = missing.groupBy("q").agg(F.count("*").alias("n"))
    kept = ranked.join(number, "q", "left").where(F.col("rank") <= k - F.coalesce("n", F.lit(0))).select("q", "chunk_id", F.lit(0).alias("late"), "rank")
    both = kept.unionByName(missing.select("q", "chunk_id", F.lit(1).alias("late"), "rank"))
    order = W.partitionBy("q").orderBy("late", "rank")
    return both.select("q", "chunk_id", F.row_number().over(order).alias("rank"), (F.col("late") == 1).alias("rare"))


def search(chunks: DataFrame, questions: DataFrame, k: int, dim: int, mode: str = "vector", rare_slots: int = 2, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(q, chunk_id, rank, rare): ranked by ``mode`` (vector, keyword or hybrid), with slots for rare literal terms."""
    ranked = (
        nearest(chunks, questions, k, dim) if mode == "vector" else keyword(chunks, questions, k) if mode == "keyword" else hybrid(chunks, questions, k, dim, weights)
    ).select("q", "chunk_id", "rank")
    slots = min(rare_slots, max(k - 1, 0))
    if not slots:
        return ranked.withColumn("rare", F.lit(False))
    return with_slots(ranked, rare_hits(chunks, questions, slots, dim), k)


def search_by_year(chunks: DataFrame, questions: DataFrame, k: int, dim: int, **how) -> DataFrame:
    """``search``, each question among the chunks of the year it names; the years asked for are few and known."""
    dated = questions.withColumn("_year", D.detect_year(F.col("query")))
    found = search(chunks, dated.where("_year IS NULL").drop("_year"), k, dim, **how)
    for row in dated.select("_year").where("_year IS NOT NULL").distinct().orderBy("_year").collect():  # 70 at most
        found = found.unionByName(search(narrowed(chunks, row._year), dated.where(F.col("_year") == row._year).drop("_year"), k, dim, **how))
    return found


def literal_coverage(chunks: DataFrame, questions: DataFrame, limit: int = 4) -> DataFrame:
    """(q, term, entries): of a question's first content words, the one in fewest entries, the earlier in ties."""
    words = F.slice(T.content_words(F.col("query"), 3), 1, limit)
    terms = questions.select("q", F.posexplode(words).alias("pos", "term")).groupBy("q", "term").agg(F.min("pos").alias("pos"))
    held = _term_hits(chunks, terms).join(chunks.select("chunk_id", "entry_id"), "chunk_id").groupBy("term").agg(F.count_distinct("entry_id").alias("entries"))
    return terms.join(held, "term").groupBy("q").agg(F.min_by(F.struct("term", "entries"), F.struct("entries", "pos")).alias("m")).select("q", "m.*")


def above(hits: DataFrame, score: str, least: float | None = None, share: float | None = None) -> DataFrame:
    """Hits over a score, and over a share of their question's best; both off unless given."""
    if least is not None:
        hits = hits.where(F.col(score) >= least)
    if share is not None:
        hits = hits.withColumn("_best", F.max(score).over(W.partitionBy("q"))).where(F.col(score) >= share * F.col("_best")).drop("_best")
    return hits
