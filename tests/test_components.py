"""Connected components against union-find; rounds on long paths."""

import random

import pytest

from contentlens.operators import components


def union_find(edges):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root.setdefault(a, a)
        root.setdefault(b, b)
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def labels(spark, edges, monkeypatch=None):
    rounds = []
    if monkeypatch:
        step = components.hook_round
        monkeypatch.setattr(components, "hook_round", lambda e, f: rounds.append(1) or step(e, f))
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["vertex"]: r["root"] for r in components.connected_components(df, "a", "b").collect()}
    return got, len(rounds)


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([5, 40, 200])
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([n // 2, n]))] + [(7, 7)]
    assert labels(spark, edges)[0] == union_find(edges)


def test_stars_nulls_and_text_ids(spark):
    edges = [(f"v{i:03}", "hub") for i in range(300)] + [("x", None), (None, "hub"), ("y", "z")]
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r["vertex"]: r["root"] for r in components.connected_components(df, "a", "b").collect()}
    assert got == union_find([e for e in edges if None not in e])


def test_empty(spark):
    assert labels(spark, [])[0] == {}


def test_long_path_in_few_rounds(spark, monkeypatch):
    n = 100_000
    ids = list(range(n))
    random.Random(5).shuffle(ids)
    got, rounds = labels(spark, list(zip(ids, ids[1:], strict=False)), monkeypatch)
    assert len(got) == n and set(got.values()) == {0}
    assert rounds < 25
