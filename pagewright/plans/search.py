"""Queries of retrieval, evaluation, staging, privacy and transcripts over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright import session
from pagewright.functions import dates as D, text as T
from pagewright.operators import answer as A, evaluate as X, index as I, privacy as P, retrieve as R, staging as G, transcript as L
from pagewright.plans import Query, table
from pagewright.plans.archive import chunks, entries, first_loaded

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIM, K = 64, 5


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_'']+')"
_STOP = "['" + "','".join(T.STOP) + "']"
_CHUNKS = "(SELECT DISTINCT chunk_id, entry_id, entry_date, chunk_index, year, trip, text FROM chunks)"
#: Searches take every question whose id is divisible by 100, against all chunks.
_ASKED = "(SELECT DISTINCT question_id AS q, question AS query, expected, wrong FROM questions WHERE question_id % 100 = 0)"


def asked(s: SparkSession, d: str, vectors: bool = False, every: bool = False) -> DataFrame:
    """The search query set, or every question."""
    rows = table(s, d, "questions").where("true" if every else "question_id % 100 = 0").select(F.col("question_id").alias("q"), F.col("question").alias("query"), "expected", "wrong").distinct()
    if not vectors:
        return rows
    known = table(s, d, "embeddings")
    n = known.count()
    return rows.withColumn("vec_id", F.col("q") % n).join(known.select("vec_id", F.col("embedding").alias("qv")), "vec_id").drop("vec_id")


def vectors_of(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d, "entry_id", "entry_date", "chunk_index", "year", "trip", "text", "vector")


# functions of questions and answers


@query(r"SELECT DISTINCT question_id, TRY_CAST(nullif(regexp_extract(question || ' in ' || (1970 + question_id % 90), '\b(19[89]\d|20[0-4]\d)\b', 1), '') AS INTEGER) AS year FROM questions")
def year_detect(s: SparkSession, d: str) -> DataFrame:
    text = F.concat("question", F.lit(" in "), (1970 + F.col("question_id") % 90).cast("string"))
    return table(s, d, "questions").select("question_id", D.detect_year(text).alias("year")).distinct()


_WORDS = "list_filter(" + _TOK.format("question") + f", lambda t: NOT list_contains({_STOP}, t) AND length(t) > 3 AND NOT regexp_matches(t, '^(19[89]\\d|20[0-4]\\d)$'))"


@query(f"""SELECT DISTINCT question_id, array_to_string({_WORDS}, ' ') AS words,
  len(list_filter({_TOK.format('question')}, lambda t: NOT list_contains({_STOP}, t) AND length(t) > 2)) BETWEEN 1 AND 2 AS short FROM questions""")
def query_words(s: SparkSession, d: str) -> DataFrame:
    q = F.col("question")
    return table(s, d, "questions").select("question_id", F.array_join(T.content_words(q, 3), " ").alias("words"), T.is_short_query(q).alias("short")).distinct()


_REFUSING = T.REFUSAL.replace("'", "''")


@query(rf"""SELECT DISTINCT gen_id, regexp_matches(coalesce(answer, ''), '{_REFUSING}') AS refused,
  array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(answer, ''), '\d{{4}}-\d{{2}}-\d{{2}}'))), ',') AS cited FROM gen_results""")
def answer_marks(s: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("answer", F.lit(""))
    return table(s, d, "gen_results").select("gen_id", T.is_refusal(text).alias("refused"), F.array_join(T.citations(text), ",").alias("cited")).distinct()


_FOLD = "lower(trim(regexp_replace(replace(replace(replace(replace(replace(replace({0}, '‘', ''''), '’', ''''), '“', '\"'), '”', '\"'), '–', '-'), '—', '-'), '[\\s\\p{{Z}}]+', ' ', 'g')))"


@query("SELECT DISTINCT gen_id, md5(" + _FOLD.format("answer") + ") AS folded FROM gen_results WHERE answer IS NOT NULL")
def folded_answers(s: SparkSession, d: str) -> DataFrame:
    """Answers folded for comparison; compatibility forms, which SQL lacks, are left as they are here."""
    return table(s, d, "gen_results").where("answer IS NOT NULL").select("gen_id", F.md5(T.folded(F.col("answer"), unicode_form=False)).alias("folded")).distinct()


@query()
def says_lists(s: SparkSession, d: str) -> DataFrame:
    """questions.says read as a comma list with quotes."""
    return table(s, d, "questions").select("question_id", "says").distinct().select("question_id", T.quoted_list(F.col("says")).alias("values"))


@query()
def snippets(s: SparkSession, d: str) -> DataFrame:
    """The best chunk of each question by keywords, shown around what matched."""
    hits = R.keyword(chunks(s, d, "text"), asked(s, d), 1).join(chunks(s, d, "text", "header_len"), "chunk_id").join(asked(s, d), "q")
    return hits.select("q", "chunk_id", T.snippet(160)("text", "header_len", "query").alias("snippet"))


# lookup


def _look(needle: str, whole: bool) -> str:
    word = f"(?i)(^|[^\\p{{L}}\\p{{N}}_])({needle})(?:$|[^\\p{{L}}\\p{{N}}_])"
    test = f"AND regexp_matches(text, '{word}')" if whole else ""
    return f"SELECT chunk_id, entry_date, chunk_index FROM {_CHUNKS} WHERE contains(lower(text), '{needle}') {test}"


@query(_look("weir", True))
def term_lookup_whole(s: SparkSession, d: str) -> DataFrame:
    return R.lookup(chunks(s, d, "entry_date", "chunk_index", "text"), "weir").select("chunk_id", "entry_date", "chunk_index")


@query(f"SELECT chunk_id, (length(text) - length(replace(lower(text), 'gate', ''))) // 4 AS count FROM {_CHUNKS} WHERE contains(lower(text), 'gate')")
def term_lookup_substring(s: SparkSession, d: str) -> DataFrame:
    return R.lookup(chunks(s, d, "entry_date", "chunk_index", "text"), "gate", whole=False).select("chunk_id", "count")


# ranking


_KNN = """
WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS v{cols} FROM embeddings{where})
SELECT q, vec_id, round(distance, 5) AS distance, rank FROM (SELECT q, vec_id, d AS distance, row_number() OVER (PARTITION BY q ORDER BY round(d, 9), vec_id) AS rank FROM (
  SELECT q, vec_id, sqrt(greatest(0, 2 - 2 * list_dot_product(qv, v) / sqrt(list_dot_product(qv, qv)) / sqrt(list_dot_product(v, v)))) AS d FROM q, v)) WHERE rank <= 10"""


def _vec_queries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))


@query(_KNN.format(cols="", where=""))
def vector_topk(s: SparkSession, d: str) -> DataFrame:
    found = R.nearest(table(s, d, "embeddings"), _vec_queries(s, d), 10, DIM, "vec_id", "embedding")
    return found.select("q", "vec_id", F.round("distance", 5).alias("distance"), "rank")


@query(_KNN.format(cols=", label", where=" WHERE label = 3"))
def vector_topk_filtered(s: SparkSession, d: str) -> DataFrame:
    found = R.nearest(table(s, d, "embeddings").where("label = 3"), _vec_queries(s, d), 10, DIM, "vec_id", "embedding")
    return found.select("q", "vec_id", F.round("distance", 5).alias("distance"), "rank")


_BM25 = f"""
q AS (SELECT q, unnest(list_distinct(list_filter({_TOK.format('query')}, lambda t: NOT list_contains({_STOP}, t)))) AS term FROM {_ASKED}),
tok AS (SELECT chunk_id, {_TOK.format('text')} AS toks FROM {_CHUNKS}), p AS (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM tok) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM tok), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
w AS (SELECT q, p.chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / mean))), 9) AS score
  FROM q JOIN p USING (term) JOIN df USING (term) JOIN tok ON tok.chunk_id = p.chunk_id, s GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, chunk_id) AS rank FROM w)"""


@query(f"WITH {_BM25} SELECT q, chunk_id, round(score, 5) AS score, rank FROM b WHERE rank <= 10")
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return R.keyword(chunks(s, d, "text"), asked(s, d), 10).select("q", "chunk_id", F.round("score", 5).alias("score"), "rank")


_FINE = "vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0"
_SIM = "list_dot_product(qv, v) / sqrt(list_dot_product(qv, qv)) / sqrt(list_dot_product(v, v))"
_VEC = f"""
qv AS (SELECT q, query, expected, wrong, embedding::DOUBLE[] AS qv FROM {_ASKED} a JOIN embeddings e ON e.vec_id = a.q % (SELECT count(*) FROM embeddings)),
cv AS (SELECT DISTINCT chunk_id, vector::DOUBLE[] AS v FROM chunks WHERE {_FINE}),
n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(distance, 9), chunk_id) AS rank FROM (SELECT q, chunk_id, sqrt(greatest(0, 2 - 2 * {_SIM})) AS distance FROM qv, cv))"""
@query(f"WITH {_VEC} SELECT q, chunk_id, round(distance, 5) AS distance, rank FROM n WHERE rank <= 10")
def nearest_chunks(s: SparkSession, d: str) -> DataFrame:
    """The chunks nearest to each question's vector; damaged vectors take no part."""
    return R.nearest(vectors_of(s, d), asked(s, d, True), 10, DIM).withColumn("distance", F.round("distance", 5))


_RRF = """
r AS (SELECT q, chunk_id, round(sum(1.0 / (60 + rank)), 12) AS rrf, min(rank) FILTER (k = 0) AS r0, min(rank) FILTER (k = 1) AS r1 FROM (
  SELECT q, chunk_id, rank, 0 AS k FROM n WHERE rank <= 20 UNION ALL SELECT q, chunk_id, rank, 1 FROM b WHERE rank <= 20) GROUP BY 1, 2),
h AS (SELECT q, chunk_id, rrf, row_number() OVER (PARTITION BY q ORDER BY rrf DESC, r0 NULLS LAST, r1 NULLS LAST, chunk_id) AS rank FROM r)"""


@query(f"WITH {_BM25} SELECT q, chunk_id, round(score, 5) AS score, rank FROM b WHERE rank <= 10")
def bm25_stored(s: SparkSession, d: str) -> DataFrame:
    """The same from a keyword index written to the shared folder, without reading the chunks' texts."""
    path = f"{session.checkpoint_folder(s)}/keywords-{uuid.uuid4().hex}"
    I.write_keyword_index(chunks(s, d, "text"), path)
    found = R.keyword(chunks(s, d), asked(s, d), 10, I.read_keyword_index(s, path))
    return found.select("q", "chunk_id", F.round("score", 5).alias("score"), "rank")


@query(f"WITH {_BM25}, {_VEC}, {_RRF} SELECT q, chunk_id, round(rrf, 9) AS rrf, rank FROM h WHERE rank <= {K}")
def rrf_hybrid(s: SparkSession, d: str) -> DataFrame:
    found = R.hybrid(vectors_of(s, d), asked(s, d, True), K, DIM)
    return found.select("q", "chunk_id", F.round("rrf", 9).alias("rrf"), "rank")


_TERMS = f"""
t0 AS (SELECT q, {_TOK.format('query')} AS toks FROM {_ASKED}),
t1 AS (SELECT q, toks, list_filter(toks, lambda t: NOT list_contains({_STOP}, t) AND length(t) > 3 AND NOT regexp_matches(t, '^(19[89]\\d|20[0-4]\\d)$')) AS words FROM t0),
t2 AS (SELECT q, words, list_concat(words, list_transform(list_filter(range(1, len(toks)), lambda i: list_contains(words, toks[i]) AND list_contains(words, toks[i + 1])), lambda i: toks[i] || ' ' || toks[i + 1]))[1:8] AS terms FROM t1),
held AS (SELECT term, chunk_id, entry_id FROM (SELECT DISTINCT unnest(terms) AS term FROM t2) x JOIN {_CHUNKS} c ON contains(lower(c.text), x.term))"""


@query(f"""WITH {_TERMS}, rare AS (SELECT term FROM held GROUP BY 1 HAVING count(DISTINCT entry_id) <= 10)
SELECT q, term, count(DISTINCT entry_id) AS entries FROM (SELECT DISTINCT q, unnest(terms) AS term FROM t2) JOIN rare USING (term) JOIN held USING (term) GROUP BY 1, 2""")
def rare_terms(s: SparkSession, d: str) -> DataFrame:
    rows = chunks(s, d, "entry_id", "text")
    terms = R.query_terms(asked(s, d)).select("q", "term").distinct()
    held = R._term_hits(rows, terms).join(rows.select("chunk_id", "entry_id"), "chunk_id").groupBy("term").agg(F.count_distinct("entry_id").alias("entries"))
    return terms.join(held.where(f"entries <= {R.RARE_ENTRIES}"), "term").select("q", "term", "entries")


_RARE = f"""
rare AS (SELECT term FROM held GROUP BY 1 HAVING count(DISTINCT entry_id) <= 10),
f AS (SELECT q, chunk_id, entry_id, count(*) AS terms FROM (SELECT DISTINCT q, unnest(terms) AS term FROM t2) JOIN rare USING (term) JOIN held USING (term) GROUP BY 1, 2, 3),
g AS (SELECT f.*, coalesce(round({_SIM}, 9), 0) AS sim FROM f JOIN qv USING (q) LEFT JOIN cv USING (chunk_id)),
o AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY q, entry_id ORDER BY terms DESC, sim DESC, chunk_id) = 1),
l AS (SELECT *, row_number() OVER w AS rank, lag(terms) OVER w AS lt, lag(sim) OVER w AS ls FROM o WINDOW w AS (PARTITION BY q ORDER BY terms DESC, sim DESC, chunk_id)),
m AS (SELECT * FROM l WHERE rank <= 2 OR (rank = 3 AND terms = lt AND sim >= ls - 0.005)),
base AS (SELECT q, chunk_id, rank FROM n WHERE rank <= {K}), miss AS (SELECT q, chunk_id, rank FROM m ANTI JOIN base USING (q, chunk_id)),
u AS (SELECT q, chunk_id, 0 AS late, rank FROM base LEFT JOIN (SELECT q, count(*) AS c FROM miss GROUP BY 1) USING (q) WHERE rank <= {K} - coalesce(c, 0) UNION ALL SELECT q, chunk_id, 1, rank FROM miss),
slots AS (SELECT q, chunk_id, row_number() OVER (PARTITION BY q ORDER BY late, rank) AS rank, late = 1 AS rare FROM u)"""


@query(f"WITH {_VEC}, {_TERMS}, {_RARE} SELECT * FROM slots")
def rare_slot_search(s: SparkSession, d: str) -> DataFrame:
    """The flagship: vector ranking with places reserved for rare literal terms."""
    return R.search(vectors_of(s, d), asked(s, d, True), K, DIM)


def flagship(s: SparkSession, d: str) -> DataFrame:
    """The same for every question."""
    return R.search(vectors_of(s, d), asked(s, d, True, every=True), K, DIM)


@query(f"""WITH {_TERMS}, w AS (SELECT DISTINCT q, unnest(words[1:4]) AS term, unnest(range(1, len(words[1:4]) + 1)) AS pos FROM t2),
held2 AS (SELECT term, count(DISTINCT entry_id) AS entries FROM (SELECT DISTINCT term FROM w) x JOIN {_CHUNKS} c ON contains(lower(c.text), x.term) GROUP BY 1)
SELECT q, term, entries FROM w JOIN held2 USING (term) QUALIFY row_number() OVER (PARTITION BY q ORDER BY entries, pos) = 1""")
def literal_coverage(s: SparkSession, d: str) -> DataFrame:
    return R.literal_coverage(chunks(s, d, "entry_id", "text"), asked(s, d))


@query(f"""WITH {_VEC}, z AS (SELECT q, rank, '[' || entry_date || '] ' || text AS b FROM n JOIN {_CHUNKS} USING (chunk_id) WHERE rank <= 10),
y AS (SELECT q, rank, b, sum(length(b)) OVER (PARTITION BY q ORDER BY rank) AS total FROM z)
SELECT q, md5(string_agg(b, chr(10) || chr(10) ORDER BY rank)) AS digest, count(*) AS kept FROM y WHERE rank = 1 OR total <= 6000 GROUP BY 1""")
def context_budget(s: SparkSession, d: str) -> DataFrame:
    rows = vectors_of(s, d)
    hits = R.nearest(rows, asked(s, d, True), 10, DIM).join(rows.select("chunk_id", "entry_date", "text"), "chunk_id")
    return A.context(hits, 6000).select("q", F.md5("context").alias("digest"), "kept")


@query()
def answers(s: SparkSession, d: str) -> DataFrame:
    """Questions answered from their excerpts by the generator without a model."""
    return A.ask(vectors_of(s, d), asked(s, d, True), A.first_sentences, K, DIM).drop("context")


# evaluation


@query(f"""WITH {_VEC}, {_TERMS}, {_RARE},
j AS (SELECT s.q, rank, entry_date, CASE WHEN NOT (len(expected) = 1 AND upper(expected[1]) = 'NONE') THEN list_filter(expected, lambda e: e IN (entry_date, entry_id, chunk_id))[1] END AS m,
  CASE WHEN NOT (len(wrong) = 1 AND upper(wrong[1]) = 'NONE') THEN list_filter(wrong, lambda e: e IN (entry_date, entry_id, chunk_id))[1] END IS NOT NULL AS bad FROM slots s JOIN {_CHUNKS} USING (chunk_id) JOIN qv ON qv.q = s.q),
k AS (SELECT q, min(rank) FILTER (m IS NOT NULL) AS rank, max(rank) FILTER (m IS NOT NULL) AS last, min_by(entry_date, rank) AS top_date, count(DISTINCT m) AS found, count(*) FILTER (bad) AS wrong_in_window FROM j GROUP BY 1)
SELECT q, k.rank, top_date, found, wrong_in_window, (SELECT count(*) FROM j WHERE j.q = k.q AND bad AND (last IS NULL OR j.rank < last)) AS wrong_above FROM k""")
def result_scores(s: SparkSession, d: str) -> DataFrame:
    rows = vectors_of(s, d)
    hits = R.search(rows, asked(s, d, True), K, DIM).join(rows.select("chunk_id", "entry_id", "entry_date"), "chunk_id").withColumn("score", F.lit(0.0))
    return X.score_hits(hits, asked(s, d, True)).select("q", "rank", "top_date", "found", "wrong_in_window", "wrong_above")


_VALUE = r"[a-z0-9\-]+-\d{4}#r?\d{4}(?:/\d+)?|\d{4}-\d{2}-\d{2}"
_RES = f"(SELECT DISTINCT result_id, question, rank, found, top_score, wrong_above, wrong_in_window, len(regexp_extract_all(coalesce(expected, ''), '{_VALUE}')) AS expected_n, regexp_matches(coalesce(expected, ''), 'NONE') AS absent FROM results)"


def results(s: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("expected", F.lit(""))
    return table(s, d, "results").select(
        "result_id", "question", "rank", "found", "top_score", "wrong_above", "wrong_in_window", F.size(F.regexp_extract_all(text, F.lit(_VALUE), F.lit(0))).alias("expected_n"), F.contains(text, F.lit("NONE")).alias("absent"),
    ).distinct()


@query(f"""
SELECT count(*) FILTER (NOT absent) AS questions, round(count(*) FILTER (NOT absent AND rank = 1) / count(*) FILTER (NOT absent), 6) AS recall_1, round(count(*) FILTER (NOT absent AND rank <= 3) / count(*) FILTER (NOT absent), 6) AS recall_3,
  round(count(*) FILTER (NOT absent AND rank <= 5) / count(*) FILTER (NOT absent), 6) AS recall_5, round(count(*) FILTER (NOT absent AND rank <= 10) / count(*) FILTER (NOT absent), 6) AS recall_k,
  round(avg(rank) FILTER (NOT absent), 6) AS mean_rank, median(rank) FILTER (NOT absent) AS median_rank, count(*) FILTER (NOT absent AND rank IS NULL) AS misses, count(*) FILTER (NOT absent AND expected_n > 1) AS multi_answer,
  sum(found) FILTER (NOT absent AND expected_n > 1) AS answers_found, sum(expected_n) FILTER (NOT absent AND expected_n > 1) AS answers_expected,
  round(sum(found) FILTER (NOT absent AND expected_n > 1) / sum(expected_n) FILTER (NOT absent AND expected_n > 1), 6) AS completeness, sum(wrong_above) FILTER (NOT absent) AS wrong_above, sum(wrong_in_window) FILTER (NOT absent) AS wrong_in_window,
  count(*) FILTER (absent) AS absent_questions, count(*) FILTER (absent AND top_score >= 0.6) AS absent_with_confident_hit FROM {_RES}""")
def recall_summary(s: SparkSession, d: str) -> DataFrame:
    return X.summary(results(s, d), 10)


_HALVES = {"o": "result_id % 2 = 0", "n": "result_id % 3 > 0"}
_RATES = "count(*) FILTER (NOT absent AND rank = 1) / count(*) FILTER (NOT absent) AS recall_1, count(*) FILTER (NOT absent AND rank <= 3) / count(*) FILTER (NOT absent) AS recall_3, count(*) FILTER (NOT absent AND rank <= 5) / count(*) FILTER (NOT absent) AS recall_5, CAST(count(*) FILTER (NOT absent AND rank IS NULL) AS DOUBLE) AS misses"


@query(f"""
WITH o AS (SELECT {_RATES} FROM {_RES} WHERE {_HALVES['o']}), n AS (SELECT {_RATES} FROM {_RES} WHERE {_HALVES['n']}),
c AS (SELECT count(*) = 0 AS comparable FROM (SELECT DISTINCT question FROM {_RES} WHERE {_HALVES['o']}) a FULL JOIN (SELECT DISTINCT question FROM {_RES} WHERE {_HALVES['n']}) b ON a.question = b.question WHERE a.question IS NULL OR b.question IS NULL),
m AS (SELECT unnest(['recall_1', 'recall_3', 'recall_5', 'misses']) AS metric, round(unnest([o.recall_1, o.recall_3, o.recall_5, o.misses]), 6) AS before, round(unnest([n.recall_1, n.recall_3, n.recall_5, n.misses]), 6) AS after FROM o, n)
SELECT metric, before, after, round(after - before, 6) AS delta, CASE WHEN abs(after - before) < 1e-9 THEN 'same' WHEN after > before THEN 'up' ELSE 'down' END AS direction, comparable FROM m, c""")
def run_deltas(s: SparkSession, d: str) -> DataFrame:
    """The metrics of the same two runs, and whether their question sets allow comparing them."""
    rates = {k: X.summary(results(s, d).where(c), 10) for k, c in _HALVES.items()}
    made = X.metric_deltas(rates["o"], rates["n"], run_compare(s, d))
    return made.withColumn("delta", F.round("delta", 6))


@query(f"""
WITH o AS (SELECT question, min(rank) AS rank FROM {_RES} WHERE result_id % 2 = 0 GROUP BY 1), n AS (SELECT question, min(rank) AS rank FROM {_RES} WHERE result_id % 3 > 0 GROUP BY 1)
SELECT coalesce(o.question, n.question) AS question, o.rank AS before, n.rank AS after, CASE WHEN o.question IS NULL THEN 'new' WHEN n.question IS NULL THEN 'gone' WHEN o.rank IS NOT DISTINCT FROM n.rank THEN 'same'
  WHEN n.rank IS NULL OR n.rank > o.rank THEN 'worse' ELSE 'better' END AS change FROM o FULL JOIN n ON o.question = n.question""")
def run_compare(s: SparkSession, d: str) -> DataFrame:
    """Two runs that share some questions: results of even ids against those not divisible by three."""
    best = lambda c: results(s, d).where(c).groupBy("question").agg(F.min("rank").alias("rank"))
    return X.compare(best("result_id % 2 = 0"), best("result_id % 3 > 0"))


_Q = "(SELECT DISTINCT question_id AS q, question, expected, wrong FROM questions)"


@query(f"""
WITH r AS (SELECT * FROM {_Q} WHERE NOT (len(expected) = 1 AND upper(expected[1]) = 'NONE') AND len(expected) > 0), v AS (SELECT q, unnest(expected) AS value FROM r)
SELECT q, 'duplicate_date' AS problem, value FROM v GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT DISTINCT q, 'unknown_date', value FROM v WHERE substr(value, 1, 10) NOT IN (SELECT entry_date FROM entries WHERE entry_date IS NOT NULL)
UNION ALL SELECT q, 'missing_says', w FROM (SELECT q, unnest(list_distinct(regexp_extract_all(lower(question), '[a-z]{{6,}}'))) AS w FROM r) x WHERE NOT EXISTS (
  SELECT 1 FROM v JOIN entries e ON e.entry_date = substr(v.value, 1, 10) WHERE v.q = x.q AND contains(lower(e.text), w))""")
def validate_questions(s: SparkSession, d: str) -> DataFrame:
    """Questions that cannot pass; their long words stand for what an answer should say."""
    q = table(s, d, "questions").select(F.col("question_id").alias("q"), "question", "expected", "wrong").distinct()
    q = q.withColumn("says", F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("[a-z]{6,}"), F.lit(0))))
    return X.validate(q, entries(s, d, "entry_date", "text"))


_GEN = "(SELECT DISTINCT gen_id, question, answer, absent, refused, cited, cited_right, cited_wrong, uncited, says, says_missing, seconds FROM gen_results)"


def gen(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "gen_results").distinct()


@query(f"""SELECT gen_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(answer, ''), '\\d{{4}}-\\d{{2}}-\\d{{2}}'))), ',') AS cited,
  array_to_string(list_filter(list_sort(list_distinct(regexp_extract_all(coalesce(answer, ''), '\\d{{4}}-\\d{{2}}-\\d{{2}}'))), lambda x: list_contains(cited_right, x)), ',') AS cited_right,
  array_to_string(list_filter(coalesce(string_split(lower(question), ' '), []), lambda t: NOT contains(lower(coalesce(answer, '')), t)), ',') AS says_missing FROM {_GEN}""")
def answer_scores(s: SparkSession, d: str) -> DataFrame:
    rows = gen(s, d).select("gen_id", "answer", F.col("cited_right").alias("expected"), F.col("cited_wrong").alias("wrong"), F.split(F.lower("question"), " ").alias("says"))
    join = lambda c: F.array_join(c, ",").alias(c)
    return X.score_answers(rows).select("gen_id", join("cited"), join("cited_right"), join("says_missing"))


_LABEL = "CASE WHEN absent THEN CASE WHEN coalesce(refused, false) THEN 'ok' ELSE 'INVENTED' END WHEN coalesce(refused, false) THEN 'REFUSED' WHEN len(says_missing) > 0 THEN 'WRONG' WHEN len(cited_right) > 0 THEN 'ok' WHEN uncited THEN 'UNCITED' ELSE 'OFF' END"


@query(f"SELECT gen_id, {_LABEL} AS label FROM {_GEN}")
def answer_labels(s: SparkSession, d: str) -> DataFrame:
    return gen(s, d).select("gen_id", X.label().alias("label"))


@query(f"""SELECT count(*) FILTER (absent AND coalesce(refused, false)) AS refused_absent, count(*) FILTER (absent) AS absent, count(*) FILTER (NOT absent AND len(cited_right) > 0) AS grounded, count(*) FILTER (NOT absent) AS real,
  count(*) FILTER (NOT absent AND len(cited_wrong) > 0 AND NOT coalesce(refused, false)) AS cited_known_wrong, count(*) FILTER (NOT absent AND refused) AS refused_real, count(*) FILTER (NOT absent AND uncited) AS uncited_real,
  round(median(seconds), 1) AS median_seconds, count(*) FILTER (NOT absent AND len(says) > 0) AS content_checked, count(*) FILTER (NOT absent AND len(says) > 0 AND NOT len(says_missing) > 0) AS content_complete FROM {_GEN}""")
def answer_summary(s: SparkSession, d: str) -> DataFrame:
    return X.answer_summary(gen(s, d))


# staging, privacy, transcripts


_STATED = f"(SELECT chunk_id, text, entry_id, regexp_extract(text, ' — ([^.!?]*[.!?])', 1) AS statement, CASE WHEN chunk_index = 0 THEN substr(text, length(regexp_extract(text, '^[^—]*— ')) + 1, 60) ELSE upper(substr(text, 20, 40)) END AS evidence FROM {_CHUNKS})"
_NAMES = "list_sort(list_distinct(list_transform(list_filter(flatten(list_transform(string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_'']+')[2:])), lambda w: regexp_matches(w, '^\\p{{Lu}}') AND NOT list_contains(['" + "','".join(T.NOT_A_NAME) + "'], lower(w))), lambda w: lower(w))))"


def statements(s: SparkSession, d: str) -> DataFrame:
    """Each chunk's first sentence as a statement, and a stretch of it as evidence."""
    skip = F.length(F.regexp_extract("text", "^[^—]*— ", 0))
    evidence = F.when(F.col("chunk_index") == 0, F.substring("text", skip + 1, F.lit(60))).otherwise(F.upper(F.substring("text", 20, 40)))
    rows = chunks(s, d, "entry_id", "chunk_index", "text").select("chunk_id", "entry_id", "text", F.regexp_extract("text", " — ([^.!?]*[.!?])", 1).alias("statement"), evidence.alias("evidence"))
    return rows.withColumn("rejected", G.rejection(F.col("statement"), F.col("evidence"), F.col("text"), unicode_form=False))


_UNKNOWN = f"list_filter({_NAMES.format('statement')}, lambda w: NOT list_contains({_NAMES.format('evidence')}, w))"
_WHY = f"CASE WHEN trim(coalesce(statement, '')) = '' THEN 'empty statement' WHEN trim(coalesce(evidence, '')) = '' THEN 'no evidence given' WHEN NOT contains({_FOLD.format('text')}, {_FOLD.format('evidence')}) THEN 'evidence not found verbatim in the entry' WHEN len({_UNKNOWN}) > 0 THEN 'names not in its evidence: ' || array_to_string({_UNKNOWN}, ', ') END"


@query(f"SELECT chunk_id, {_WHY} AS rejected FROM {_STATED}")
def evidence_verify(s: SparkSession, d: str) -> DataFrame:
    return statements(s, d).select("chunk_id", "rejected")


@query(f"SELECT split_part(rejected, ':', 1) AS reason, count(*) AS statements FROM (SELECT {_WHY} AS rejected FROM {_STATED}) WHERE rejected IS NOT NULL GROUP BY 1")
def rejection_reasons(s: SparkSession, d: str) -> DataFrame:
    return G.reasons(statements(s, d))


_GENERIC = "['" + "','".join(P.GENERIC) + "']"
_ORDINARY = "['" + "','".join(sorted({*P.GENERIC, *P.ORDINARY})) + "']"


@query(f"""
WITH n AS (SELECT DISTINCT lower(trim(trip)) AS value FROM entries WHERE trip IS NOT NULL AND trim(trip) <> '' AND NOT regexp_matches(trim(trip), '^[0-9]{{4}}$'))
SELECT DISTINCT value FROM (SELECT value FROM n UNION ALL SELECT unnest(string_split_regex(value, '[\\s/_-]+')) FROM n) WHERE length(value) > 3 AND NOT list_contains({_GENERIC}, value)""")
def private_names(s: SparkSession, d: str) -> DataFrame:
    return P.names(table(s, d, "entries").select(F.col("trip").alias("place")).distinct())


@query("SELECT entry_date AS value FROM entries WHERE entry_date <> '' UNION SELECT entry_date FROM chunks WHERE entry_date <> ''")
def private_dates(s: SparkSession, d: str) -> DataFrame:
    return P.dates(table(s, d, "entries"), table(s, d, "chunks"))


_REAL = "(SELECT DISTINCT lower(trim(question)) AS question, regexp_extract_all(lower(question), '[a-z0-9'']+') AS t, wrong FROM questions WHERE NOT coalesce(len(expected) = 1 AND upper(expected[1]) = 'NONE', false))"
_CONTENT = f"NOT list_contains({_STOP}, {{0}}) AND length({{0}}) > 3"


@query(f"""
WITH r AS {_REAL}, e AS (SELECT DISTINCT id, lower(text) AS text FROM entries WHERE text IS NOT NULL),
w AS (SELECT DISTINCT value FROM (SELECT unnest(t) AS value FROM r) WHERE {_CONTENT.format('value')} AND NOT list_contains({_ORDINARY}, value)),
s AS (SELECT DISTINCT lower(trim(value)) AS value FROM (SELECT unnest(wrong) AS value FROM r) WHERE trim(value) <> '' AND NOT list_contains({_ORDINARY}, lower(trim(value)))),
c AS (SELECT value, count(DISTINCT id) AS df FROM (SELECT value FROM w UNION SELECT value FROM s) x JOIN e ON contains(e.text, value) GROUP BY 1),
p AS (SELECT 'phrase' AS kind, question AS value FROM r UNION SELECT 'phrase', unnest(list_transform(list_filter(range(1, len(t)), lambda i: {_CONTENT.format('t[i]')} AND {_CONTENT.format('t[i + 1]')}), lambda i: t[i] || ' ' || t[i + 1])) FROM r
  UNION SELECT 'word', value FROM w JOIN c USING (value) WHERE df BETWEEN 1 AND 15 UNION SELECT CASE WHEN contains(value, ' ') THEN 'phrase' ELSE 'word' END, value FROM s LEFT JOIN c USING (value) WHERE coalesce(df, 0) <= 15)
SELECT DISTINCT kind, value FROM p WHERE kind = 'word' OR length(value) > 8""")
def private_phrases(s: SparkSession, d: str) -> DataFrame:
    """Phrases and words of the questions; their known-wrong values stand for what an answer should say."""
    q = table(s, d, "questions").select("question", "expected", F.col("wrong").alias("says")).distinct()
    return P.phrases(q, entries(s, d, "text"))


@query(f"""
WITH n AS (SELECT DISTINCT lower(trim(trip)) AS value FROM entries WHERE trip IS NOT NULL AND length(trim(trip)) > 3 AND NOT contains(trim(trip), ' ') AND regexp_matches(lower(trim(trip)), '^[a-z]+$') AND NOT list_contains({_GENERIC}, lower(trim(trip)))),
a AS (SELECT DISTINCT gen_id, answer FROM gen_results WHERE answer IS NOT NULL), d AS (SELECT DISTINCT entry_date AS value FROM entries WHERE entry_date <> '')
SELECT DISTINCT gen_id, 'name' AS kind, value FROM (SELECT gen_id, unnest(regexp_extract_all(lower(answer), '[\\p{{L}}\\p{{N}}_]+')) AS value FROM a) JOIN n USING (value)
UNION ALL SELECT DISTINCT gen_id, 'date', value FROM (SELECT gen_id, unnest(regexp_extract_all(answer, '\\d{{4}}-\\d{{2}}-\\d{{2}}')) AS value FROM a) JOIN d USING (value)""")
def pattern_scan(s: SparkSession, d: str) -> DataFrame:
    """Answers that name trips or days of the archive."""
    trips = table(s, d, "entries").select(F.lower(F.trim("trip")).alias("value")).distinct().where(F.col("value").rlike("^[a-z]{4,}$") & ~F.col("value").isin(P.GENERIC))
    patterns = trips.select(F.lit("name").alias("kind"), "value").unionByName(P.dates(table(s, d, "entries")).select(F.lit("date").alias("kind"), "value"))
    return P.scan(table(s, d, "gen_results").select("gen_id", "answer").distinct().where("answer IS NOT NULL"), patterns, "gen_id", "answer")


_INJ = " OR ".join("contains(substr(text, 1, 200), '" + m.replace("'", "''") + "')" for m in L.INJECTED)
_EVENTS = rf"""
l AS (SELECT DISTINCT project, log_file, line_no, max(ts) OVER (PARTITION BY project, log_file) AS written, CASE lower(trim(coalesce(type, message.role))) WHEN 'human' THEN 'user' ELSE lower(trim(coalesce(type, message.role))) END AS kind, message.content AS c,
  regexp_matches(coalesce(message.content, ''), '^\s*\[\s*(\{{|\]|$)') AS listed FROM log_events),
x AS (SELECT project, log_file, line_no, kind, trim(CASE WHEN listed AND json_valid(c) THEN array_to_string(list_transform(list_filter(CAST(c AS JSON[]), lambda b: b->>'type' = 'text'), lambda b: b->>'text'), chr(10))
  WHEN NOT listed THEN c END, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM l),
y AS (SELECT *, kind = 'user' AND coalesce(text, '') <> '' AND NOT ({_INJ}) AS turn, kind = 'user' AND coalesce(text, '') <> '' AND ({_INJ}) AS skip, kind = 'assistant' AND coalesce(text, '') <> '' AS reply FROM x),
w AS (SELECT project, log_file, max(written) AS written FROM l GROUP BY ALL),
z AS (SELECT y.*, count(*) FILTER (turn) OVER (PARTITION BY project ORDER BY written, log_file, line_no) AS n, row_number() OVER (PARTITION BY project ORDER BY written, log_file, line_no) AS place FROM y JOIN w USING (project, log_file)),
t AS (SELECT project, n AS turn, max(text) FILTER (turn) AS prompt, count(*) FILTER (reply) AS replies, md5(coalesce(string_agg(text, chr(10) ORDER BY place) FILTER (reply), '')) AS said FROM z WHERE n > 0 AND (turn OR reply) GROUP BY 1, 2)"""


_SHELL = "regexp_matches(prompt, '(?s)^<bash-input>.*?</bash-input>')"


@query(f"WITH {_EVENTS} SELECT project, turn, CASE WHEN {_SHELL} THEN trim(regexp_extract(prompt, '(?s)^<bash-input>(.*?)</bash-input>', 1)) ELSE prompt END AS prompt, replies, said FROM t")
def transcript_turns(s: SparkSession, d: str) -> DataFrame:
    made = L.turns(table(s, d, "log_events"))
    return made.select("project", "turn", "prompt", F.size("replies").cast("bigint").alias("replies"), F.md5(F.array_join("replies", "\n")).alias("said"))


@query(f"WITH {_EVENTS} SELECT (SELECT count(*) FROM t) AS exchanges, (SELECT count(*) FROM t WHERE {_SHELL}) AS shell_commands, (SELECT count(*) FROM t WHERE replies = 0 AND NOT {_SHELL}) AS unanswered, (SELECT count(*) FROM y WHERE skip) AS skipped")
def transcript_counts(s: SparkSession, d: str) -> DataFrame:
    return L.counts(table(s, d, "log_events"))


@query(f"""WITH {_EVENTS}, b AS (SELECT project, n AS turn, string_agg(text, chr(10) || chr(10) ORDER BY place) FILTER (reply) AS body FROM z WHERE n > 0 AND (turn OR reply) GROUP BY 1, 2)
SELECT project, turn, '[' || turn || '] ' || CASE WHEN {_SHELL} THEN 'YOU (in the shell)' ELSE 'YOU' END || chr(10) || chr(10) || CASE WHEN {_SHELL} THEN trim(regexp_extract(prompt, '(?s)^<bash-input>(.*?)</bash-input>', 1)) ELSE prompt END
  || CASE WHEN body IS NOT NULL THEN chr(10) || chr(10) || 'REPLY' || chr(10) || chr(10) || body WHEN {_SHELL} THEN '' ELSE chr(10) || chr(10) || '[no reply recorded]' END AS text FROM t JOIN b USING (project, turn)""")
def transcript_text(s: SparkSession, d: str) -> DataFrame:
    """Turns as readable text, over a project's files."""
    return L.render(L.turns(table(s, d, "log_events")))


@query("SELECT DISTINCT chunk_id, CAST(64 AS INTEGER) AS dim FROM chunks")
def embedded_chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks embedded by the embedder without a model."""
    return I.embed(chunks(s, d, "text"), I.hashed_words(DIM)).select("chunk_id", F.size("vector").alias("dim"))


@query()
def staged_statements(s: SparkSession, d: str) -> DataFrame:
    """Statements a generator without a model makes of entries: the first sentence, quoting itself; verified."""

    def quoting(_: str, text: str):
        import json

        first = " ".join(text.split(". ")[0].split())
        yield json.dumps({"statement": first, "evidence": first})

    return G.stage(first_loaded(s, d, "entry_date", "text").where("text IS NOT NULL"), quoting)
