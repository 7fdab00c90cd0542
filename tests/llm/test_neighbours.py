import numpy as np

from pagewright.llm.neighbours import Tree, most_similar


def cloud(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    v = centres[rng.integers(len(centres), size=n)] + 0.25 * rng.normal(size=(n, dim))
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def exact(v, k):
    s = v @ v.T
    np.fill_diagonal(s, -9)
    return {(i, int(j)) for i, row in enumerate(np.argsort(-s, axis=1)[:, :k]) for j in row}


def test_tree_is_exact_at_factor_one():
    v = cloud(1500)
    tree = Tree(v, leaf=16)
    q, m, s = tree.search(v, 6, -1.0, 1.0)
    found = {}
    for a, b, c in zip(q.tolist(), m.tolist(), s.tolist()):
        if a != b:
            found.setdefault(a, []).append((-c, b))
    assert {(a, b) for a, x in found.items() for _, b in sorted(x)[:5]} == exact(v, 5)


def frame(spark, v, extra=()):
    return spark.createDataFrame([(f"c{i:05}", [float(x) for x in row], "n") for i, row in enumerate(v)] + list(extra), "id string, v array<float>, neighbour string")


def pairs(df):
    return {(int(r.id[1:]), int(r.neighbour[1:])) for r in df.collect()}


def test_exact_at_one_and_high_recall_below(spark):
    v = cloud(1200)
    df = frame(spark, v)
    truth = exact(v, 5)
    assert pairs(most_similar(df, "id", "v", dim=16, route=1.0, factor=1.0, shard=100)) == truth
    near = {(a, b) for a, b in truth if v[a] @ v[b] >= 0.85}
    found = pairs(most_similar(df, "id", "v", dim=16, minimum=0.85, route=0.15, shard=100))
    assert len(found & near) >= 0.9 * len(near) and all(v[a] @ v[b] >= 0.8499 for a, b in found)


def test_crowded_cells_and_shards_are_searched_in_blocks(spark):
    v = cloud(1000)
    v[:330] = v[0] + 0.01 * np.random.default_rng(1).normal(size=(330, 16))  # a third of all in one place
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    found = pairs(most_similar(frame(spark, v), "id", "v", dim=16, route=1.0, factor=1.0, shard=100, most=40, group=60))
    assert len(found & exact(v, 5)) >= 0.999 * 5000


def test_damaged_repeated_and_equal_vectors(spark):
    v = cloud(60)
    bad = [("x1", None, "n"), ("x2", [], "n"), ("x3", [1.0], "n"), ("x4", [0.0] * 16, "n"), ("x5", [float("nan")] * 16, "n")]
    again = [("c00003", [float(x) for x in v[3]], "n")] * 3
    copies = [(f"d{i:05}", [1.0] + [0.0] * 15, "n") for i in range(40)]
    rows = most_similar(frame(spark, v, bad + again + copies), "id", "v", dim=16, minimum=0.9).collect()
    assert not [r for r in rows if r.id[0] == "x" or r.neighbour[0] == "x" or r.id == r.neighbour]
    of = {}
    for r in rows:
        of.setdefault(r.id, []).append(r.neighbour)
    assert all(len(set(of[f"d{i:05}"])) == 5 for i in range(40))
    assert of["d00030"] == [f"d{i:05}" for i in range(5)]
    assert most_similar(frame(spark, v[:1]), "id", "v", dim=16).count() == 0
    assert most_similar(frame(spark, v[:0]), "id", "v", dim=16).count() == 0
