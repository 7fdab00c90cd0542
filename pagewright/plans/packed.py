"""Queries of the packed-field operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.operators.packed import unpack_values
from pagewright.plans import Query, table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of questions.says and results.expected, in place order."""
    says = table(spark, folder, "questions").select("question_id", "says").distinct()
    expected = table(spark, folder, "results").select("result_id", "expected").distinct()
    shape = lambda df, name, key: df.select(
        F.lit(name).alias("field_name"), F.col(key).cast("bigint").alias("row_id"), "pos", "value"
    )
    return (
        shape(unpack_values(says, "question_id", "says", opening="says"), "questions.says", "question_id")
        .unionByName(shape(unpack_values(expected, "result_id", "expected", tokens=True), "results.expected", "result_id"))
        .distinct()
    )


QUERIES: dict[str, Query] = {"p4_found": p4_found}
SQL: dict[str, str] = {}
