"""Interval labels against a recursive walk."""

import random

import pytest
from pyspark.sql import functions as F

from contentlens.operators import intervals


def walk(nodes):
    """{id: (depth, enter, leave)} by depth-first search from the roots."""
    children = {}
    for i, p in nodes:
        children.setdefault(p, []).append(i)
    out, number = {}, 0
    todo = [(i, 0) for i in sorted(children.get(None, []), reverse=True)]
    order = []
    while todo:
        i, d = todo.pop()
        out[i] = [d, number, number]
        order.append(i)
        number += 1
        todo += [(c, d + 1) for c in sorted(children.get(i, []), reverse=True)]
    parent = dict(nodes)
    for i in reversed(order):
        if parent[i] is not None:
            out[parent[i]][2] = max(out[parent[i]][2], out[i][2])
    return {i: tuple(v) for i, v in out.items()}


def frame(spark, nodes, kind="long"):
    return spark.createDataFrame([(i, p, 1) for i, p in nodes], f"id {kind}, parent_id {kind}, size int")


def labels(spark, nodes, kind="long"):
    return intervals.interval_labels(frame(spark, nodes, kind))


def as_dict(df):
    return {r["id"]: (r["depth"], r["enter"], r["leave"]) for r in df.collect()}


def forest(seed, n):
    rng = random.Random(seed)
    ids = rng.sample(range(10 * n), n)
    nodes = [(v, rng.choice(ids[max(0, k - 6) : k]) if k and rng.random() < 0.9 else None) for k, v in enumerate(ids)]
    nodes += [(-1, -2), (-2, -3), (-3, -1), (-4, -2), (-5, -4), (-6, -7), (-8, -6), (-9, -9)]  # cycles, below them, no parent row
    rng.shuffle(nodes)
    return nodes


@pytest.mark.parametrize("seed, n", [(1, 60), (2, 400), (3, 1)])
def test_labels_equal_walk(spark, seed, n):
    nodes = forest(seed, n)
    assert as_dict(labels(spark, nodes)) == walk(nodes)


def test_chain_and_wide_parent(spark):
    n = 12_000
    chain = [(i, i - 1 if i else None) for i in range(n)]
    got = as_dict(labels(spark, chain))
    assert got == {i: (i, i, n - 1) for i in range(n)}
    wide = [(0, None)] + [(i, 0) for i in range(1, n)] + [(n + i, None) for i in range(500)]
    assert as_dict(labels(spark, wide)) == walk(wide)


def test_text_ids_and_empty(spark):
    nodes = [("b", None), ("a", None), ("c", "b"), ("aa", "b"), ("z", "aa"), ("q", "none")]
    assert as_dict(labels(spark, nodes, "string")) == walk(nodes)
    assert as_dict(labels(spark, [])) == {}
    assert as_dict(labels(spark, [(1, 2), (2, 1)])) == {}


def test_ranges_answer_walks(spark):
    nodes = forest(9, 200)
    ranked = intervals.stored(labels(spark, nodes), "labels")
    want, parent = walk(nodes), dict(nodes)
    for i in [*list(want)[:6], -1, 10**9]:
        above, p = set(), parent.get(i) if i in want else None
        while p is not None:
            above.add(p)
            p = parent[p]
        assert {r["id"] for r in intervals.ancestors_by_interval(ranked, i).collect()} == above
        below = {j for j in want if i in want and want[i][1] < want[j][1] <= want[i][2]}
        assert {r["id"] for r in intervals.descendants_by_interval(ranked, i).collect()} == below
    seeds = list(want)[::17] + [-1, 10**9, None]
    got = [r["id"] for r in intervals.subtrees_by_interval(ranked, spark.createDataFrame([(s,) for s in seeds], "x long")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {j for j in want if any(s in want and want[s][1] <= want[j][1] <= want[s][2] for s in seeds)}
    assert intervals.subtrees_by_interval(ranked, ranked.select("id").where(F.lit(False))).isEmpty()
