"""The k most similar vectors of every vector, by vantage-point trees per shard.

Shards are the cells of vantage points drawn from the vectors, POINTS of them at most
(16 MB at 64 numbers each, which travel with the tasks). A cell that holds many times
its share - where vectors crowd, or where there are more than POINTS shards of them - is cut
again by points drawn from its own vectors; those stay in a table and meet their cell's
vectors there. A vector lives in the shard of the nearest points. A query visits a cell
only if the triangle inequality leaves room for a neighbour there: members of cell j lie
at least (d(q, j) - d(q, nearest)) / 2 away. In a shard a vantage-point tree halves the
members by their distance to a vantage point, and a half is passed over if it is
further away than the k-th neighbour known so far. ``route`` and ``factor``
relax the bounds; at one they are those of an exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from pagewright.session import cut

#: Members of a shard aimed at, of a tree's leaf, and of one task's block of a shard.
SHARD, LEAF, MOST = 500, 64, 4000
#: Points of the first level, at most, and of one cell of the second; a cell of SPLIT shards is cut again.
POINTS, CELL, SPLIT = 1 << 16, 4096, 8
#: Vectors drawn per shard to fit the points; vectors of a crowded cell that one task routes; distances made at once.
DRAWN, GROUP, WORK = 16, 50_000, 1 << 22


class Tree:
    """A vantage-point tree over unit vectors, searched for many queries together."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 0):
        self.points, self.leaf = points, leaf
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, members: np.ndarray):
        if len(members) <= self.leaf:
            return members
        at = self.points[members[self.rng.integers(len(members))]]
        d = distance(self.points[members] @ at)
        middle = float(np.median(d))
        inner = d <= middle
        if inner.all():  # most members at one distance
            return members
        return at, middle, self._build(members[inner]), self._build(members[~inner])

    def search(self, queries: np.ndarray, k: int, minimum: float, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, member, cosine) of candidates: at least the k best members of a query that reach ``minimum``."""
        self.queries, self.k, self.minimum, self.factor = queries, k, minimum, factor
        self.best = np.full((len(queries), k), minimum, dtype=np.float32)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._visit(self.root, np.arange(len(queries)))
        if not self.found:
            none = np.empty(0, np.int64)
            return none, none, np.empty(0, np.float32)
        return tuple(np.concatenate(x) for x in zip(*self.found))  # type: ignore[return-value]

    def _visit(self, node, asked: np.ndarray) -> None:
        if not len(asked):
            return
        if isinstance(node, np.ndarray):
            likeness = self.queries[asked] @ self.points[node].T
            q, m = np.nonzero(likeness >= np.maximum(self.best[asked, -1], self.minimum)[:, None])
            if len(q):
                self.found.append((asked[q], node[m], likeness[q, m]))
                rows = np.unique(q)
                both = np.concatenate([self.best[asked[rows]], likeness[rows]], axis=1)
                self.best[asked[rows]] = -np.sort(np.partition(-both, self.k, axis=1)[:, : self.k], axis=1)
            return
        at, middle, inner, outer = node
        d = distance(self.queries[asked] @ at)
        near = d <= middle
        for first, second, side in ((inner, outer, near), (outer, inner, ~near)):
            self._visit(first, asked[side])
            reach = self.factor * distance(self.best[asked[side], -1])
            self._visit(second, asked[side][np.abs(d[side] - middle) <= reach])


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def top(owner: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores of each owner."""
    order = np.lexsort((other, -score, owner))
    own = owner[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    return order[rank < k]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, v): one row per key, its vector scaled to length one; vectors missing, of another length, zero or with NaN left out."""
    v = F.col(vector).cast("array<float>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    fine = df.select(F.col(key).alias("id"), v.alias("v"), norm.alias("n")).where(
        F.col("id").isNotNull() & (F.size("v") == dim) & (F.col("n") > 0) & (F.col("n") < math.inf) & ~F.isnan("n")
    )
    return fine.groupBy("id").agg(F.min(F.transform("v", lambda x: (x.cast("double") / F.col("n")).cast("float"))).alias("v"))


def _routes(vectors: np.ndarray, points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the nearest) of the cells in which a row can have neighbours within ``reach``."""
    out, step = [], max(16, WORK // len(points))
    for at in range(0, len(vectors), step):
        d = distance(vectors[at : at + step] @ points.T)
        least, home = d.min(axis=1), d.argmin(axis=1)
        row, cell = np.nonzero((d - least[:, None]) / 2 <= reach)
        out.append((row + at, cell, home[row] == cell))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def most_similar(
    df: DataFrame, key: str, vector: str, *, dim: int, k: int = 5, minimum: float = -1.0, route: float = 0.07, factor: float = 0.7, shard: int = SHARD, most: int = MOST, group: int = GROUP
) -> DataFrame:
    """(key, neighbour, rank, cosine): up to k other keys most similar to each, none under ``minimum``.

    Repeated rows of a key count once; unusable vectors take no part; ties go by
    key. More than k+1 equal vectors stand in the search by their k+1 smallest
    keys, and the rest get the first k of those. The points are drawn from a sample of
    DRAWN vectors per shard by hash; every vector is indexed. A crowded shard is
    searched in blocks of about ``most`` by separate tasks, a crowded cell routed in
    blocks of about ``group``. No rows give no rows; extra columns are ignored.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = cut(usable(df, key, vector, dim).withColumns({"copy": F.struct(F.xxhash64("v"), F.hash("v")), "h": F.xxhash64("id")}))
    alike = W.partitionBy("copy").orderBy("id")
    # keys alone are ranked, and the limit applies before the shuffle as well, so many copies are no burden
    lead = rows.select("copy", "id").withColumn("at", F.row_number().over(alike)).where(F.col("at") <= k + 1)
    lasts = lead.where(F.col("at") == k + 1).select("copy", F.col("id").alias("last"))
    held = rows.join(lasts, "copy", "left").where(F.col("last").isNull() | (F.col("id") <= F.col("last"))).select("id", "h", "v")
    total = rows.count()
    shards = max(1, total // shard)
    wide = min(POINTS, shards)
    drawn = rows.where(F.pmod("h", F.lit(max(1, total // (shards * DRAWN)))) == 0).select("h", "v")
    chosen = drawn.orderBy("h").limit(wide).select("v").toArrow()
    if not chosen.num_rows:
        chosen = rows.orderBy("h").limit(1).select("v").toArrow()
    points = _matrix(chosen.column("v"), dim)
    reach = route * math.sqrt(max(0.0, 2.0 - 2.0 * minimum))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell, home = _routes(_matrix(batch.column(1), dim), points, 0.0)
            where = np.zeros(batch.num_rows, np.int32)
            where[row[home]] = cell[home]
            yield pa.RecordBatch.from_arrays([pa.array(where), batch.column(0), batch.column(1)], names=["cell", "h", "v"])

    sample = drawn.mapInArrow(at_home, "cell int, h long, v array<float>")
    per = max(1.0, total / max(1, shards * DRAWN))  # vectors that one drawn stands for
    crowd = {r.cell: r["count"] * per for r in sample.groupBy("cell").count().collect()}  # one row per point
    blocks = np.array([max(1, math.ceil(crowd.get(c, 1) / group)) for c in range(max(1, len(points)))], dtype=np.int64)
    room = {c: min(CELL, round(n / shard)) if n > SPLIT * shard else 1 for c, n in crowd.items()}
    limit = F.row_number().over(W.partitionBy("cell").orderBy("h"))

    def fit(table: pa.Table) -> pa.Table:
        """The cell's own points, and the blocks each of its shards is searched in."""
        cell, vectors = table.column("cell")[0].as_py(), _matrix(table.column("v"), dim)
        own = vectors[: room.get(cell, 1)]
        row, sub, home = _routes(vectors, own, 0.0)
        met = np.bincount(sub[home], minlength=len(own)) * (crowd.get(cell, 1) / len(vectors))
        n = np.maximum(1, np.ceil(met / most)).astype(np.int32)
        spread = int(blocks[cell])
        types = [pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.list_(pa.int32())]
        arrays = [pa.array([cell] * spread, types[0]), pa.array(range(spread), types[1]), pa.array([own.ravel()] * spread, types[2]), pa.array([n] * spread, types[3])]
        return pa.Table.from_arrays(arrays, names=["cell", "block", "points", "blocks"])

    fitted = sample.withColumn("n", limit).where(F.col("n") <= CELL * DRAWN).drop("n").groupBy("cell").applyInArrow(fit, "cell int, block int, points array<float>, blocks array<int>")

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell, home = _routes(_matrix(batch.column(2), dim), points, reach)
            block = batch.column(1).to_numpy()[row] % blocks[cell]
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(home), *(batch.column(c).take(index) for c in range(3))],
                names=["cell", "block", "home", "id", "h", "v"],
            )

    text = pa.string() if kind == "string" else pa.from_numpy_dtype(np.dtype({"bigint": "int64", "int": "int32"}[kind]))
    shard_schema = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("home", pa.bool_()), ("id", text), ("v", pa.list_(pa.float32()))])

    def to_shards(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return shard_schema.empty_table()
        vectors = _matrix(left.column("v"), dim)
        if right.num_rows:
            own, parts = _matrix(right.column("points").chunk(0)[:1], dim), np.array(right.column("blocks")[0].as_py(), dtype=np.int64)
        else:  # a cell of which no vector was drawn
            own, parts = np.zeros((1, dim), np.float32), np.ones(1, np.int64)
        row, sub, near = _routes(vectors, own, reach)
        near &= left.column("home").to_numpy()[row]
        # a vector is a member in one block of its shard, and asks in all blocks
        n = parts[sub]
        first = np.repeat(np.cumsum(n) - n, n)
        part = np.arange(n.sum()) - first
        row, sub, near = np.repeat(row, n), np.repeat(sub, n), np.repeat(near, n)
        near &= left.column("h").to_numpy()[row] % parts[sub] == part
        index = pa.array(row)
        cell = left.column("cell")[0].as_py()
        return pa.Table.from_arrays(
            [pa.array(cell * CELL + sub), pa.array(part.astype(np.int32)), pa.array(near), left.column("id").take(index), left.column("v").take(index)], schema=shard_schema
        )

    cells = held.mapInArrow(to_cells, f"cell int, block int, home boolean, id {kind}, h long, v array<float>")
    if max(room.values(), default=1) > 1 or blocks.max() > 1:
        routed = cells.groupBy("cell", "block").cogroup(fitted.groupBy("cell", "block")).applyInArrow(to_shards, f"shard long, part int, home boolean, id {kind}, v array<float>")
    else:  # no cell is cut again: the second level would be the first
        routed = cells.select(F.col("cell").cast("long").alias("shard"), F.lit(0).alias("part"), "home", "id", "v")

    def search(table: pa.Table) -> pa.Table:
        vectors, home = _matrix(table.column("v"), dim), table.column("home").to_numpy()
        members = np.flatnonzero(home)
        if not len(members):
            return out_schema.empty_table()
        q, m, s = Tree(vectors[members]).search(vectors, k + 1, minimum, factor)
        m = members[m]
        other = q != m
        q, m, s = q[other], m[other], s[other]
        forth, back = top(q, m, s, k), top(m, q, s, k)
        a, b, c = np.r_[q[forth], m[back]], np.r_[m[forth], q[back]], np.r_[s[forth], s[back]]
        ids = table.column("id")
        return pa.Table.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(c.astype(np.float64))], schema=out_schema)

    out_schema = pa.schema([("id", text), ("neighbour", text), ("cosine", pa.float64())])
    pairs = routed.groupBy("shard", "part").applyInArrow(search, f"id {kind}, neighbour {kind}, cosine double")
    rest = (
        rows.select("copy", "id")
        .join(lasts, "copy")
        .where(F.col("id") > F.col("last"))
        .select("id", "copy")
        .join(lead.where(F.col("at") <= k).select("copy", F.col("id").alias("neighbour")), "copy")
        .select("id", "neighbour", F.lit(1.0).alias("cosine"))
    )
    best = pairs.groupBy("id", "neighbour").agg(F.max("cosine").alias("cosine")).unionAll(rest)
    order = W.partitionBy("id").orderBy(F.col("cosine").desc(), "neighbour")
    return (
        best.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("id").alias(key), "neighbour", "rank", "cosine")
    )
