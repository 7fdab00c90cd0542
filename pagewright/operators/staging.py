"""Statements drawn from entries, kept only with evidence that stands in the entry."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pagewright.functions import text as T
from pagewright.operators.answer import Generator


def select(entries: DataFrame, dates: list[str] | None = None, number: int | None = None, seed: int = 0) -> DataFrame:
    """Entries of given days, or ``number`` of them by seeded hash."""
    if dates:
        return entries.where(F.col("entry_date").isin(dates))
    return entries.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(number) if number else entries


def rejection(statement: Column, evidence: Column, entry: Column, unicode_form: bool = True) -> Column:
    """Why a statement is not supported; null where it is."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    unknown = F.array_except(T.names_in(statement), T.names_in(evidence))
    listed = F.concat(F.lit("names not in its evidence: "), F.array_join(F.array_sort(unknown), ", "))
    verbatim = F.contains(T.folded(F.coalesce(entry, F.lit("")), unicode_form), T.folded(evidence, unicode_form))
    return (
        F.when(blank(statement), "empty statement").when(blank(evidence), "no evidence given")
        .when(~verbatim, "evidence not found verbatim in the entry").when(F.size(unknown) > 0, listed)
    )


def stage(entries: DataFrame, generator: Generator) -> DataFrame:
    """(entry_id, entry_date, statement, evidence, rejected): the statements a generator makes of entries, each verified."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(reply=["".join(generator("state", t or "")) for t in frame["text"]])

    rows = entries.select(F.col("id").alias("entry_id"), "entry_date", "text").mapInPandas(run, "entry_id string, entry_date string, text string, reply string")
    made = rows.select("entry_id", "entry_date", "text", F.explode(T.reply_statements(F.col("reply"))).alias("s")).select("entry_id", "entry_date", "text", "s.*")
    return made.withColumn("rejected", rejection(F.col("statement"), F.col("evidence"), F.col("text"))).drop("text")


def reasons(statements: DataFrame) -> DataFrame:
    """(reason, statements): rejections by what stands before the colon."""
    return statements.where("rejected IS NOT NULL").groupBy(F.split("rejected", ":")[0].alias("reason")).agg(F.count("*").alias("statements"))
