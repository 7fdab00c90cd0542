"""Ordered neighbours and running sums over groups of any size.

Rows are windowed in blocks of their order value; only one row per block meets
in a group's own window, so a group that holds a third of all rows is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BLOCK = 4096


def with_neighbours(df: DataFrame, group: str, order: str, value: Column, block: int = BLOCK) -> DataFrame:
    """``df`` with before2, before1 and after1: ``value`` of the two rows before and the one after in its group.

    ``order`` is a whole number, unique in a group. Null where there is no such row.
    """
    rows = df.withColumns({"_value": F.struct(value.alias("v")), "_block": F.floor(F.col(order) / block)})
    inner = W.partitionBy(group, "_block").orderBy(order)
    rows = rows.withColumns(
        {"_b1": F.lag("_value", 1).over(inner), "_b2": F.lag("_value", 2).over(inner), "_a1": F.lead("_value", 1).over(inner), "_at": F.row_number().over(inner)}
    )
    edges = rows.groupBy(group, "_block").agg(
        F.min_by("_value", order).alias("_first"),
        F.max_by(F.struct(F.array_compact(F.array("_b1", "_value")).alias("x")), order)["x"].alias("_last"),
    )
    line = W.partitionBy(group).orderBy("_block")
    none = F.array().cast("array<struct<v:string>>")
    kind = edges.schema["_last"].dataType.simpleString()
    past = F.concat(*(F.coalesce(F.lag("_last", k).over(line), none.cast(kind)) for k in (2, 1)))
    edges = edges.select(group, "_block", past.alias("_past"), F.lead("_first").over(line).alias("_next"))
    joined = rows.join(edges, [group, "_block"])
    past_at = lambda k: F.try_element_at("_past", F.lit(-k))
    return joined.select(
        *(joined[c] for c in df.columns),
        F.coalesce("_b2", F.when(F.col("_at") == 1, past_at(2)).when(F.col("_at") == 2, past_at(1)))["v"].alias("before2"),
        F.coalesce("_b1", F.when(F.col("_at") == 1, past_at(1)))["v"].alias("before1"),
        F.coalesce("_a1", F.col("_next"))["v"].alias("after1"),
    )


def with_running(df: DataFrame, group: str, order: str, sums: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """``df`` with each of ``sums`` summed over the rows up to and with this one in its group."""
    rows = df.withColumns({f"_{n}": c.cast("bigint") for n, c in sums.items()} | {"_block": F.floor(F.col(order) / block)})
    inner = W.partitionBy(group, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    line = W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(group, "_block").agg(*(F.sum(f"_{n}").alias(f"_t_{n}") for n in sums))
    totals = totals.select(group, "_block", *(F.coalesce(F.sum(f"_t_{n}").over(line), F.lit(0)).alias(f"_p_{n}") for n in sums))
    joined = rows.withColumns({f"_s_{n}": F.sum(f"_{n}").over(inner) for n in sums}).join(totals, [group, "_block"])
    return joined.select(*(joined[c] for c in df.columns), *((F.col(f"_s_{n}") + F.col(f"_p_{n}")).alias(n) for n in sums))
