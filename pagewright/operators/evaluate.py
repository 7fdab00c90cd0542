"""Retrieval and answers scored against known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagewright.functions import text as T
from pagewright.operators.privacy import counts_in_blocks

WEAK = 0.60


def score_hits(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(q, rank, score, top_score, top_date, found, matched, wrong_in_window, wrong_above) of every question.

    ``hits`` has q, rank, chunk_id, entry_id, entry_date and score; ``questions`` q,
    expected and wrong. Wrong hits count as above if they stand before the last
    right one, all of them if there is none.
    """
    row = (F.col("entry_date"), F.col("entry_id"), F.col("chunk_id"))
    judged = hits.join(questions.select("q", "expected", "wrong"), "q").select(
        "q", "rank", "score", "entry_date", T.matched(F.col("expected"), *row).alias("m"), T.matched(F.col("wrong"), *row).isNotNull().alias("bad")
    )
    right = F.when(F.col("m").isNotNull(), F.col("rank"))
    sums = judged.groupBy("q").agg(
        F.min(right).alias("rank"),
        F.min_by("score", right).alias("score"),
        F.min_by("score", "rank").alias("top_score"),
        F.min_by("entry_date", "rank").alias("top_date"),
        F.count_distinct("m").cast("int").alias("found"),
        F.min_by("m", right).alias("matched"),
        F.max(right).alias("_last"),
        F.sort_array(F.collect_list(F.when(F.col("bad"), F.col("rank")))).alias("_bad"),  # no longer than the window
    )
    above = F.filter("_bad", lambda r: F.col("_last").isNull() | (r < F.col("_last")))
    return questions.select("q").join(sums, "q", "left").select(
        "q", "rank", "score", "top_score", "top_date", F.coalesce("found", F.lit(0)).alias("found"), "matched",
        F.coalesce(F.size("_bad"), F.lit(0)).alias("wrong_in_window"), F.coalesce(F.size(above), F.lit(0)).alias("wrong_above"),
    )


def summary(results: DataFrame, k: int) -> DataFrame:
    """One row of rates over results (rank, found, expected_n, absent, top_score, wrong_above, wrong_in_window)."""
    real, rank = ~F.col("absent"), F.col("rank")
    hit = real & rank.isNotNull()
    n = F.count_if(real)
    rate = lambda c: F.round(F.count_if(hit & c) / F.nullif(n, F.lit(0)), 6)
    multi = real & (F.col("expected_n") > 1)
    total = lambda c, name: F.coalesce(F.sum(F.when(c, F.col(name))), F.lit(0))
    return results.agg(
        n.alias("questions"),
        rate(rank == 1).alias("recall_1"), rate(rank <= 3).alias("recall_3"), rate(rank <= 5).alias("recall_5"), rate(rank <= k).alias("recall_k"),
        F.round(F.avg(F.when(hit, rank)), 6).alias("mean_rank"), F.median(F.when(hit, rank)).alias("median_rank"),
        F.count_if(real & rank.isNull()).alias("misses"),
        F.count_if(multi).alias("multi_answer"), total(multi, "found").alias("answers_found"), total(multi, "expected_n").alias("answers_expected"),
        F.round(F.sum(F.when(multi, F.col("found"))) / F.nullif(F.sum(F.when(multi, F.col("expected_n"))), F.lit(0)), 6).alias("completeness"),
        total(real, "wrong_above").alias("wrong_above"), total(real, "wrong_in_window").alias("wrong_in_window"),
        F.count_if(~real).alias("absent_questions"), F.count_if(~real & (F.col("top_score") >= WEAK)).alias("absent_with_confident_hit"),
    )


def validate(questions: DataFrame, entries: DataFrame) -> DataFrame:
    """(q, problem, value): duplicate_date, unknown_date and missing_says of questions that can never pass."""
    real = questions.where(~T.is_absent(F.col("expected")) & (F.size("expected") > 0))
    twice = F.array_distinct(F.filter("expected", lambda d: F.size(F.filter("expected", lambda e: e == d)) > 1))
    dup = real.select("q", F.lit("duplicate_date").alias("problem"), F.explode(twice).alias("value"))
    dates = entries.where(F.col("entry_date").isNotNull()).select(F.col("entry_date").alias("_d"))
    asked = real.select("q", F.explode(F.array_distinct("expected")).alias("value")).withColumn("_d", F.substring("value", 1, 10))
    unknown = asked.join(dates.distinct(), "_d", "left_anti").select("q", F.lit("unknown_date").alias("problem"), "value")
    says = real.select("q", F.explode(F.array_distinct("says")).alias("value"))
    # the days asked for, then one pass over their texts for all that should be said; no text goes into a join with questions
    texts = entries.select(F.col("entry_date").alias("_d"), "text").join(asked.select("_d").distinct(), "_d", "left_semi")
    terms = says.select("q", "value", F.lower("value").alias("term"))
    met = counts_in_blocks(texts, "_d", "text", terms.select(F.col("term").alias("value"))).select("_d", "term").distinct()
    said = met.join(terms, "term").join(asked.select("q", "_d").distinct(), ["q", "_d"]).select("q", "value").distinct()
    missing = says.join(said, ["q", "value"], "left_anti").select("q", F.lit("missing_says").alias("problem"), "value")
    return dup.unionByName(unknown).unionByName(missing)


def score_answers(answers: DataFrame) -> DataFrame:
    """Answers (answer, expected, wrong, says) with cited, cited_right, cited_wrong, refused, uncited, says_missing."""
    within = lambda pool: F.filter("cited", lambda d: F.exists(F.coalesce(pool, F.array().cast("array<string>")), lambda e: F.contains(e, d)))
    text = F.coalesce("answer", F.lit(""))
    rows = answers.withColumns({"cited": T.citations(text), "refused": T.is_refusal(text)})
    missing = F.filter(F.coalesce("says", F.array().cast("array<string>")), lambda t: ~F.contains(F.lower(text), F.lower(t)))
    return rows.withColumns(
        {"cited_right": within(F.col("expected")), "cited_wrong": within(F.col("wrong")), "uncited": (F.size("cited") == 0) & ~F.col("refused"), "says_missing": missing}
    )


def label() -> Column:
    """ok, INVENTED, REFUSED, WRONG, UNCITED or OFF for a row of answer scores."""
    refused = F.coalesce("refused", F.lit(False))
    return (
        F.when(F.col("absent"), F.when(refused, "ok").otherwise("INVENTED"))
        .when(refused, "REFUSED")
        .when(F.size("says_missing") > 0, "WRONG")
        .when(F.size("cited_right") > 0, "ok")
        .when(F.col("uncited"), "UNCITED")
        .otherwise("OFF")
    )


def answer_summary(rows: DataFrame) -> DataFrame:
    """One row of counts over answer scores."""
    absent, refused = F.col("absent"), F.coalesce("refused", F.lit(False))
    real, some = ~absent, lambda c: F.size(c) > 0
    return rows.agg(
        F.count_if(absent & refused).alias("refused_absent"), F.count_if(absent).alias("absent"),
        F.count_if(real & some("cited_right")).alias("grounded"), F.count_if(real).alias("real"),
        F.count_if(real & some("cited_wrong") & ~refused).alias("cited_known_wrong"), F.count_if(real & refused).alias("refused_real"),
        F.count_if(real & F.col("uncited")).alias("uncited_real"), F.round(F.median("seconds"), 1).alias("median_seconds"),
        F.count_if(real & some("says")).alias("content_checked"), F.count_if(real & some("says") & ~some("says_missing")).alias("content_complete"),
    )


def filtered(questions: DataFrame, needle: str) -> tuple[DataFrame, DataFrame]:
    """(questions that hold ``needle``, one row: kept, every, comparable); rates of a part are not comparable with those of the whole."""
    holds = F.contains(F.lower("query"), F.lit(needle.lower()))
    counted = questions.agg(F.count_if(holds).alias("kept"), F.count("*").alias("every"))
    return questions.where(holds), counted.withColumn("comparable", F.col("kept") == F.col("every"))


METRICS = ("recall_1", "recall_3", "recall_5", "misses")


def metric_deltas(before: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """(metric, before, after, delta, direction, comparable) of two summaries of one row, with ``changes`` as of ``compare``.

    A metric that either run lacks is left out. Rates are not comparable where questions came or went.
    """
    sets = changes.agg(F.coalesce(F.count_if(F.col("change").isin("new", "gone")) == 0, F.lit(True)).alias("comparable"))
    pairs = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"o.{m}").cast("double").alias("before"), F.col(f"n.{m}").cast("double").alias("after")) for m in METRICS))
    one = F.broadcast  # rows of one each
    rows = before.alias("o").join(one(after.alias("n"))).select(F.explode(pairs).alias("m")).select("m.*").where("before IS NOT NULL AND after IS NOT NULL")
    delta = F.round(F.col("after") - F.col("before"), 9)
    direction = F.when(F.abs(delta) < 1e-9, "same").when(delta > 0, "up").otherwise("down")
    return rows.withColumns({"delta": delta, "direction": direction}).join(one(sets))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(question, before, after, change): new, gone, better or worse ranks between two runs; one row a question in each."""
    o, n = F.col("o.rank"), F.col("n.rank")
    joined = before.alias("o").join(after.alias("n"), F.col("o.question") == F.col("n.question"), "full")
    change = (
        F.when(F.col("o.question").isNull(), "new").when(F.col("n.question").isNull(), "gone")
        .when(o.eqNullSafe(n), "same").when(n.isNull() | (n > o), "worse").otherwise("better")
    )
    return joined.select(F.coalesce("o.question", "n.question").alias("question"), o.alias("before"), n.alias("after"), change.alias("change"))
