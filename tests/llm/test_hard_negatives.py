"""13. Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentlens.llm import hard_negatives as hn


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    known = {}
    for i, v, c in rows:
        if i is None or c is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        known[i, c, tuple(math.floor(256 * x) for x in v)] = None
    known = list(known)
    out = []
    for a in known:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], r[2], strict=False)), r[0], r[1]) for r in known if r != a)
        same = [r for r in scored if r[2] == a[1]][:positives]
        for s, p, _ in same:
            inside = [r for r in scored if r[2] != a[1] and low * -s <= 100 * -r[0] <= high * -s]
            out += [(a[0], p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(inside[:negatives])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, c, "x", 1) for i, v, c in rows], f"vec_id long, embedding array<{kind}>, label int, tree string, lane int")


def vectors(seed, n, dim, common=0.0):
    rng = random.Random(seed)
    one = [rng.choice([-1, -0.5, 0.25, 1]) for _ in range(dim)]
    return [
        (i, one if rng.random() < common else [np.float32(rng.gauss(0.2, 0.5)).item() for _ in range(dim)], rng.randrange(4)) for i in range(n)
    ]


@pytest.mark.parametrize("n, dim, common", [(700, 6, 0.0), (900, 2, 0.4), (300, 1, 0.0)])
def test_equals_brute_force(spark, n, dim, common):
    rows = vectors(n, n, dim, common)
    # small trees, tiles from a small sample, several blocks of anchors
    mined = hn.hard_negatives(frame(spark, rows), anchors=F.col("vec_id") % 20 == 0, tree_values=dim * 100, sample=120, block=7)
    assert got(mined) == brute(rows, every=20)


def test_boxes_prune_and_bound():
    rows = np.floor(np.random.default_rng(2).normal(0, 30, (1000, 3)))
    rows = rows[hn.str_order(rows, hn.LEAF)]
    lo, hi = hn.boxes(rows)
    levels = hn.levels_of(len(rows))
    assert levels[-1][0] + 1 == len(lo) and (lo[-1] == rows.min(0)).all() and (hi[-1] == rows.max(0)).all()
    a = np.array([3.0, -2.0, 5.0])
    most = np.maximum(a, 0) @ hi.T + np.minimum(a, 0) @ lo.T
    scores = rows @ a
    for k in range(levels[0][1]):
        assert scores[k * hn.LEAF : (k + 1) * hn.LEAF].max() <= most[k]
    opened = (most[: levels[0][1]] >= np.sort(scores)[-5]).sum()
    assert opened < levels[0][1] / 2


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1),  # equal rows are one
        (100, [0.0, 0.0], 1), (200, [-0.0, 0.0], 2), (300, [], 2), (400, [1.0], 1), (500, [-1.0, -1.0], 3),
        (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (3, [0.5, 0.25], 2), (4, [0.5, 0.25], 2), (5, [0.25, 0.5], 2), (6, [0.25, 0.5], 3),
        (None, [1.0, 1.0], 1), (7, None, 1), (8, [1.0, None], 1), (9, [1.0, nan], 2), (10, [inf, 1.0], 2), (11, [1.0, 1.0], None), (12, [-inf], 2),
        (-100, [0.75, 0.75], 2), (-200, [0.5, 0.5], 4),
    ]
    assert got(hn.hard_negatives(frame(spark, rows))) == brute(rows)


def test_scores_beyond_floating_point(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(1 << 20, 1 << 21)), float(rng.randrange(1 << 18))], i % 3) for i in range(60)]
    assert got(hn.hard_negatives(frame(spark, rows, "double"), anchors=F.col("vec_id") % 10 == 0)) == brute(rows, every=10)


def test_empty_and_without_anchors(spark):
    assert got(hn.hard_negatives(frame(spark, []))) == []
    assert got(hn.hard_negatives(frame(spark, vectors(1, 50, 3)[1:]))) == []


def test_one_label_only(spark):
    rows = [(i, v, 1) for i, v, _ in vectors(5, 120, 3)]
    assert got(hn.hard_negatives(frame(spark, rows))) == []


def test_query_over_given_embeddings(spark):
    from contentlens.llm.catalog import QUERIES

    path = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    given = [(r["vec_id"], list(r["embedding"]), (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in rows]
    assert got(QUERIES["op13_hard_negatives"](spark, path)) == brute(given)
