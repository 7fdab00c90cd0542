"""Fixed-capacity containers filled with items of varying length.

Bulk-synchronous best fit. Sizes and gaps are whole numbers up to the capacity, so
what is matched are runs: the items of one size, and the containers of one gap. In a
round the runs are ranged by value and each size goes to the range of its successor,
the least gap that holds it; every range is swept by a task of its own, which fits
sizes to their successors, the largest first where several want one gap, by rank
where a run wants more containers than there are; what found no room, and the gaps
as they are now, go into the next round. Sizes are let in by halving classes, large
ones first; what no gap holds opens containers at the end of its class. The plan
meets the rows by (size, part, rank), so rows are moved once and never gathered.
"""

from __future__ import annotations

import base64
import functools
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from pagewright.session import cut, spread

CAPACITY = 2048
#: Rows of one size that are ranked by one task, at most, and values that one task sweeps in a round.
PART, RANGE = 1_000_000, 512
#: Splitting pattern of the vocabulary files (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(2)
def _encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding("pagewright", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """(key, tokens) of every row, in tokens of the public vocabulary file at ``vocabulary``; a null text has 0.

    The file's bytes (under 1 MB) travel with the task.
    """
    with open(vocabulary, "rb") as f:
        data = f.read()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(data).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["key", "tokens"])

    return spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(run, f"key {kind}, tokens bigint").withColumnRenamed("key", key)


Run = tuple[int, int, int]


def sweep(sizes: list[Run], gaps: list[Run], capacity: int = 0, opened: int | None = None) -> tuple[list[tuple], list[Run], list[Run]]:
    """(plan, sizes left, gaps left) of best fit, largest size first, over runs of sizes (size, first rank, items) and gaps (gap, first container, containers).

    Of the plan's (size, first rank, items, first container, items in each) an item of
    rank r goes to container first + (r - first rank) // each. With ``opened`` what
    finds no gap opens containers from that number on.
    """
    plan: list[tuple] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    known: list[int] = []

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in runs:
                runs[gap] = []
                insort(known, gap)
            runs[gap].append((first, number))

    for gap, first, number in sorted(gaps):
        leave(gap, first, number)
    spare: list[Run] = []
    for size, rank, left in sorted(sizes, key=lambda r: (-r[0], r[1])):
        for gap in known[bisect_left(known, size) :]:
            if not left:
                break
            each, found = gap // size, runs.pop(gap)
            known.remove(gap)
            for first, number in found:
                take = min(left, number * each)
                if take:
                    plan.append((size, rank, take, first, each))
                    rank, left = rank + take, left - take
                full, part = divmod(take, each)
                leave(gap - each * size, first, full)
                leave(gap - part * size, first + full, min(1, part))
                leave(gap, first + full + min(1, part), number - full - min(1, part))
        if left and opened is not None:
            each = capacity // size
            plan.append((size, rank, left, opened, each))
            full, part = divmod(left, each)
            leave(capacity - each * size, opened, full)
            leave(capacity - part * size, opened + full, min(1, part))
            opened += full + min(1, part)
        elif left:
            spare.append((size, rank, left))
    return plan, spare, [(gap, first, number) for gap, found in runs.items() for first, number in found]


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """The plan of one sweep over all sizes, in one place: what the rounds are tested against."""
    return sweep([(s, 0, n) for s, n in counts.items() if n and s > 0], [], capacity, 0)[0]


_STATE = "kind string, value long, first long, n long, container long, each long"


def rounds(runs: DataFrame, capacity: int, width: int = RANGE) -> DataFrame:
    """(size, first, n, container, each): the plan for runs of (size, n), made in bulk-synchronous rounds.

    The state of a round is a table of the runs that are left, of gaps and of the plan so
    far; one row per range comes to the driver between rounds, to tell which are open.
    """
    none = F.lit(None).cast("long")
    state = cut(runs.select(F.lit("s").alias("kind"), F.col("size").alias("value"), F.lit(0).cast("long").alias("first"), "n", none.alias("container"), none.alias("each")))
    band = F.floor(F.col("value") / width).cast("int")

    def run_from(opened: int | None):
        def run(table: pa.Table) -> pa.Table:
            return swept_table(table, opened)

        return run

    def swept_table(table: pa.Table, opened: int | None) -> pa.Table:
        rows = [*zip(*(table.column(c).to_pylist() for c in ("kind", "value", "first", "n")))]
        plan, spare, gaps = sweep([r[1:] for r in rows if r[0] == "s"], [r[1:] for r in rows if r[0] == "g"], capacity, opened)
        out = [("p", *r) for r in plan] + [(kind, *r, None, None) for kind, own in (("s", spare), ("g", gaps)) for r in own]
        types = [pa.string(), *[pa.int64()] * 5]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip([*zip(*out)] or [()] * 6, types)], names=["kind", "value", "first", "n", "container", "each"])

    opened, high, wide = 0, capacity, capacity // width + 1
    while high:
        low = high // 2 if high > capacity // 16 else 0
        let_in = (F.col("kind") == "s") & (F.col("value") > low)
        while True:
            met = state.where(let_in | (F.col("kind") == "g")).groupBy("kind", band.alias("band")).agg(F.max("value").alias("top"), F.min("value").alias("least")).collect()
            tops = {r.band: r.top for r in met if r.kind == "g"}
            least = min((r.least for r in met if r.kind == "s"), default=None)
            if least is None:
                break
            if least > max(tops.values(), default=0):
                # nothing fits anywhere: containers are opened, in one sweep over the class's runs
                made = state.where(let_in).groupBy().applyInArrow(run_from(opened), _STATE)
                state = cut(state.where(~let_in).unionByName(made).coalesce(wide))
                last = state.where("kind = 'p'").agg(F.max(F.expr("container + (n + each - 1) DIV each")).alias("n")).first()
                opened = max(opened, int(last.n or 0))
                break
            fits = F.array(*(F.struct(F.lit(k).alias("band"), F.lit(top).alias("top")) for k, top in sorted(tops.items())))
            target = F.filter(fits, lambda f: (f["band"] >= band) & (f["top"] >= F.col("value")))
            routed = state.withColumn("target", F.when(F.col("kind") == "g", band).when(let_in, F.try_element_at(target, F.lit(1))["band"]))
            swept = routed.where(F.col("target").isNotNull()).groupBy("target").applyInArrow(run_from(None), _STATE)
            state = cut(routed.where(F.col("target").isNull()).drop("target").unionByName(swept).coalesce(wide))
        high = low
    return state.where("kind = 'p'").select(F.col("value").alias("size"), "first", "n", "container", "each")


def pack_containers(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, *, part: int = PART) -> DataFrame:
    """(key, piece, first_token, tokens, container_id): where every item goes.

    An item over the capacity becomes pieces of exactly one container and a rest;
    no other item is divided. Items of size 0 or null take no room and come out
    with a null container. Repeated rows are items of their own; other columns
    are ignored; no rows give no rows. Rows of one size are ranked in parts of
    about ``part`` rows, so a size that most rows share is not one task.
    """
    item = F.coalesce(F.col(size).cast("bigint"), F.lit(0))
    pieces = sizes.select(F.col(key).alias("key"), item.alias("size")).select(
        "key",
        F.posexplode(
            F.concat(
                F.array_repeat(F.lit(capacity).cast("bigint"), F.floor(F.col("size") / capacity).cast("int")),
                F.when((F.col("size") % capacity > 0) | (F.col("size") == 0), F.array(F.col("size") % capacity)).otherwise(
                    F.array().cast("array<bigint>")
                ),
            )
        ).alias("piece", "tokens"),
    )
    rows = cut(pieces)
    parts = rows.count() // part + 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", "piece"), F.lit(parts)).cast("int"))
    counted = cut(rows.where("tokens > 0").groupBy("tokens", "part").agg(F.count("*").alias("n")))
    plan = rounds(counted.groupBy(F.col("tokens").alias("size")).agg(F.sum("n").alias("n")), capacity)
    # where each part of a size stands among its ranks, with the runs of the plan that it meets
    before = F.sum("n").over(W.partitionBy("tokens").orderBy("part")) - F.col("n")
    spans = counted.withColumn("before", before).join(plan.withColumnsRenamed({"n": "take"}), F.col("tokens") == F.col("size"))
    spans = spans.where((F.col("first") < F.col("before") + F.col("n")) & (F.col("first") + F.col("take") > F.col("before")))
    spans = spans.groupBy("tokens", "part", "before").agg(F.collect_list(F.struct("first", "take", "container", "each")).alias("runs"))
    rank = F.col("before") + F.col("at") - 1
    run = F.try_element_at(F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["first"] + r["take"])), F.lit(1))
    order = W.partitionBy("tokens", "part").orderBy("key", "piece")
    placed = rows.withColumn("at", F.row_number().over(order)).join(spans, ["tokens", "part"], "left").withColumn("rank", rank).withColumn("run", run)
    return placed.select(
        F.col("key").alias(key), "piece", (F.col("piece") * F.lit(capacity).cast("bigint")).alias("first_token"), "tokens",
        (F.col("run.container") + F.floor((F.col("rank") - F.col("run.first")) / F.col("run.each"))).alias("container_id"),
    )
