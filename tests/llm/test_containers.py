import random
from collections import Counter

import pytest

from pagewright.llm.containers import best_fit, pack_containers, rounds, token_counts


def filled(counts, capacity):
    load, seen = Counter(), Counter()
    for size, a, n, first, each in best_fit(counts, capacity):
        assert seen[size] == a
        seen[size] = a + n
        for r in range(n):
            load[first + r // each] += size
    assert seen == Counter({s: n for s, n in counts.items() if n})
    return load


def decreasing(counts, capacity):
    gaps = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fits = [k for k, g in enumerate(gaps) if g >= size]
            if fits:
                gaps[min(fits, key=lambda k: gaps[k])] -= size
            else:
                gaps.append(capacity - size)
    return gaps


def test_plan_equals_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.randint(5, 60)
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        load = filled(counts, capacity)
        assert max(load.values()) <= capacity
        assert sorted(capacity - x for x in load.values()) == sorted(decreasing(counts, capacity))


def test_rows(spark):
    sizes = [2, 2, 3, 3, 5, 5, 5, 10, 25, 0, None, 2, 2, 7]
    df = spark.createDataFrame([(k, s, 0) for k, s in enumerate(sizes)], "id bigint, n int, container_id int")
    rows = pack_containers(df, "id", "n", 10).collect()
    load = Counter()
    for r in rows:
        if r.tokens:
            load[r.container_id] += r.tokens
        else:
            assert r.container_id is None
    assert max(load.values()) <= 10 and sum(load.values()) == sum(s or 0 for s in sizes) and len(load) == 8
    assert sorted(r.first_token for r in rows if r.id == 8) == [0, 10, 20]
    assert {r.id for r in rows} == set(range(len(sizes)))
    assert pack_containers(df.limit(0), "id", "n", 10).count() == 0


def test_one_size_for_most_rows(spark):
    rows = pack_containers(spark.range(5000).selectExpr("id", "if(id < 4000, 4, id % 10) AS n"), "id", "n", 10).collect()
    load = Counter()
    for r in rows:
        if r.tokens:
            load[r.container_id] += r.tokens
    assert max(load.values()) <= 10


def test_tokens(spark):
    P = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "two words"), (2, ""), (3, None), (4, "<|endoftext|>" * 3)], "id int, text string")
    got = dict(map(tuple, token_counts(df, "id", "text", P.path("byte_bpe_50k.tiktoken")).collect()))
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 3


def test_rounds_fill_as_well_as_one_sweep(spark):
    rng = random.Random(4)
    counts = {rng.randint(1, 300): rng.randint(1, 40) for _ in range(60)}
    df = spark.createDataFrame([*counts.items()], "size long, n long")
    load, seen = Counter(), Counter()
    for r in rounds(df, 300, width=64).collect():
        seen[r["size"]] += r.n
        for k in range(r.n):
            load[r.container + k // r.each] += r["size"]
    assert seen == Counter(counts) and max(load.values()) <= 300 and sorted(load) == [*range(len(load))]
    best = -(-sum(s * n for s, n in counts.items()) // 300)
    assert len(load) <= max(len(filled(counts, 300)), best) + 2


def test_parts_of_a_hot_size(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 7, id % 11) AS n")
    rows = pack_containers(df, "id", "n", 20, part=100).collect()
    load = Counter()
    for r in rows:
        if r.tokens:
            load[r.container_id] += r.tokens
    assert len(rows) == 3000 and max(load.values()) <= 20 and all((r.container_id is None) == (r.tokens == 0) for r in rows)
    assert len(load) <= sum(load.values()) / 20 * 1.02 + 1
