"""5. Jaccard join against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contentlens.llm.common import connected_components
from contentlens.llm.jaccard_join import (
    BRANCH, BUCKET, LEVELS, PLACES, RECALL, _buckets, alike_places, describe, intersections, jaccard_classes, runs_for,
)
from contentlens.llm.textsets import runs, signatures, word_hashes


def sets_of(texts):
    grams, at = runs(*word_hashes(pa.array(texts, pa.string())), 5)
    return [np.unique(grams[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def brute(rows):
    sets = sets_of([t for _, t in rows])
    n = len(rows)
    near: list[set] = [set() for _ in range(n)]
    for i in range(n):
        for k in range(i):
            common = len(np.intersect1d(sets[i], sets[k]))
            if common and common >= 0.8 * (len(sets[i]) + len(sets[k]) - common) - 1e-9:
                near[i].add(k)
                near[k].add(i)
    out, seen = [], {}
    for i in range(n):
        if i not in seen:
            todo, group = [i], {i}
            while todo:
                for k in near[todo.pop()] - group:
                    group.add(k)
                    todo.append(k)
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            for k in group:
                seen[k] = min(ids) if ids else None
        out.append((rows[i][0], seen[i], len(near[i])))
    return sorted(out, key=str)


def family(rng, first, count, words, changes):
    base = [f"v{rng.randrange(900)}" for _ in range(words)]
    rows = []
    for i in range(count):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(words)] = f"c{rng.randrange(10**6)}"
        rows.append((first + i, " ".join(own)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], "doc_id long, text string, sid string, size string, root string")


def test_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for f in range(12):
        rows += family(rng, 1000 * f, rng.randint(1, 9), rng.randint(30, 300), 4)
    rows += [(50_000, None), (50_001, ""), (50_002, ""), (50_003, "!!"), (50_004, "a b"), (50_005, "A, b."), (50_006, "b a")]
    rows += [rows[0]] * 7 + [(7, "one text"), (7, "another text"), (None, rows[3][1]), (None, "lonely words here")]
    rows.append((60_000, " ".join(f"u{i}" for i in range(20_000))))
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_hot_family_over_blocks(spark):
    rng = random.Random(4)
    rows = family(rng, 0, 160, 120, 4) + [(900 + i, f"alone {i} words of its own {i * 7} here {i}") for i in range(20)]
    rng.shuffle(rows)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_classes(frame(spark, rows), bucket=8, block=32).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert jaccard_classes(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=2, max_size=12))
def test_intersections(sets):
    got = intersections([np.array(sorted(s), np.uint64) for s in sets])
    assert got.tolist() == [[len(a & b) for b in sets] for a in sets]


def test_signatures_estimate_similarity():
    rng = random.Random(1)
    a, b = (t for _, t in family(rng, 0, 2, 3000, 60))
    sa, sb = sets_of([a, b])
    true = len(np.intersect1d(sa, sb)) / len(np.union1d(sa, sb))
    sig = signatures(np.concatenate([sa, sb]), np.array([0, len(sa), len(sa) + len(sb)]), 512)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.08


def test_runs_reach_the_recall():
    assert (1 - 0.8**2) ** runs_for(0.9999, 0.8, 2) <= 1e-4 and alike_places(0.8, 64) < 0.8 * 64


def test_connected_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(200, 300)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(None, 1), (500, 500)]
    got = {r.vertex: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want: dict = {}
    for a, b in edges:
        if a is not None and a != b:
            want.setdefault(a, a), want.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and a != b and want[a] != want[b]:
                want[a] = want[b] = min(want[a], want[b])
                changed = True
    assert got == want


def exact_links(texts):
    """Pairs of texts with a similarity of 0.8 or more, by shared shingles."""
    sets = [s.tolist() for s in sets_of(texts)]
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    shared = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    return [p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n) - 1e-9]


def test_recall_and_work_on_given_documents(spark):
    """All exact pairs of sf0.01 are linked, and the compared pairs grow in
    proportion from sf0.01 to sf0.1, not with the square."""
    compared = {}
    for size in ("sf0.01", "sf0.1"):
        docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text")
        rows = docs.withColumn("th", F.xxhash64("text"))
        sets = describe(rows.select("doc_id", "th", "text"), 5, PLACES).where("sig IS NOT NULL").groupBy("sid").agg(F.first("sig").alias("sig"))
        met = _buckets(sets, runs_for(RECALL, 0.8), PLACES, BRANCH, LEVELS, BUCKET, 5)
        compared[size] = met.groupBy("bucket").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]
        if size == "sf0.01":
            texts = [r.text for r in docs.orderBy("doc_id").collect()]
            want = 2 * len(exact_links(texts))
            got = jaccard_classes(docs).agg(F.sum("n_links")).first()[0]
            assert want > 100 and got == want
    assert compared["sf0.1"] < 14 * compared["sf0.01"]


def test_recall_at_the_threshold(spark):
    """Pairs of just over 0.8 in one bucket that has to be split several times."""
    rng = random.Random(6)
    common = [f"c{i}" for i in range(150)]
    rows = []
    for k in range(120):
        own = common + [f"o{k}_{i}" for i in range(700)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[:-88] + [f"n{rng.randrange(10**9)}" for _ in range(88)]))]
    links = exact_links([t for _, t in rows])
    assert len(links) == 120
    got = jaccard_classes(frame(spark, rows), bucket=4)
    assert sum(r.n_links for r in got.collect()) >= 0.95 * 240
