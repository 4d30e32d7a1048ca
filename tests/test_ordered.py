"""Ordered walks: one range exchange, state carried over partitions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from contentlens.operators import changes as chg
from contentlens.operators import ordered

EVENTS = "event_id long, ts timestamp_ntz, user_id long, comment_id long, action string"
DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def many_partitions(spark):
    """Ranges of a few rows, so that keys run over several partitions."""
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def log(seed, n=900):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        # one pair holds a third of the log; some pairs have one event
        pair = (1, 1) if rng.random() < 0.34 else (rng.choice([1, 2, 3, 50 + i]), rng.randrange(4))
        out.append((i, DAY + dt.timedelta(seconds=rng.randrange(300)), *pair, rng.choice(["like", "unlike", "like", "poke"])))
    rng.shuffle(out)
    return out


def walk(likes, events):
    state = {p: True for p in likes}
    out = {}
    for _, ts, u, c, action in sorted(events, key=lambda e: (e[1], e[0])):
        if action not in ("like", "unlike"):
            continue
        p = (u, c)
        liked, accepted, rejected, since = out.get(p, (state.get(p, False), 0, 0, None))
        if liked != (action == "like"):
            liked, accepted = not liked, accepted + 1
            since = ts if liked else since
        else:
            rejected += 1
        out[p] = (liked, accepted, rejected, since)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_like_log_equals_replay(spark, many_partitions, seed):
    events, old = log(seed), DAY - dt.timedelta(days=9)
    likes = {(1, 1), (2, 2), (3, 0), (900, 900)}
    e = spark.createDataFrame(events, EVENTS)
    stored = spark.createDataFrame([(u, c, old) for u, c in likes], "user_id long, comment_id long, created_at timestamp_ntz")
    want = walk(likes, events)
    got = {(r["user_id"], r["comment_id"]): (r["liked"], r["accepted"], r["rejected"], r["liked_since"])
           for r in chg.like_event_outcomes(stored, e).collect()}
    assert got == want
    after = {(r["user_id"], r["comment_id"]): r["created_at"] for r in chg.apply_like_events(stored, e).collect()}
    end = {p: old for p in likes if p not in want}
    end |= {p: since or old for p, (liked, _, _, since) in want.items() if liked}
    assert after == end


def test_text_keys_nulls_and_empty_logs(spark):
    rows = [(1, DAY, "a", "x", "like"), (2, DAY, "a", "x", "unlike"), (3, DAY, None, "x", "like"), (4, DAY, None, "x", "like"), (5, DAY, "b", None, "unlike")]
    kind = "event_id long, ts timestamp_ntz, user_id string, comment_id string, action string"
    likes = spark.createDataFrame([], "user_id string, comment_id string, created_at timestamp_ntz")
    got = {(r["user_id"], r["comment_id"]): (r["liked"], r["accepted"], r["rejected"]) for r in chg.like_event_outcomes(likes, spark.createDataFrame(rows, kind)).collect()}
    assert got == {("a", "x"): (False, 2, 0), (None, "x"): (True, 1, 1), ("b", None): (False, 0, 1)}
    assert chg.like_event_outcomes(likes, spark.createDataFrame([], kind)).isEmpty()
    assert chg.apply_like_events(likes, spark.createDataFrame([], kind)).isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_counters_equal_replay(spark, many_partitions, seed):
    rng = random.Random(seed)
    deltas = [(rng.choice([1, 1, 1, rng.randrange(2, 40)]), k, rng.choice([1, -1, -1])) for k in range(700)]
    old = {i: rng.randrange(4) for i in range(45)}
    want = dict(old)
    for i, _, d in deltas:
        want[i] = max(0, want[i] + d)
    rng.shuffle(deltas)
    got = chg.counter_after_deltas(
        spark.createDataFrame(list(old.items()), "id long, like_count long"), spark.createDataFrame(deltas, "id long, seq long, delta int")
    )
    assert {r["id"]: r["new"] for r in got.collect()} == want


def test_log_is_exchanged_once(spark):
    """A log of many events: one exchange by ranges, then rows per pair."""
    e = spark.createDataFrame(log(1), EVENTS).where(F.col("action") != "poke")
    rows = e.select("user_id", "comment_id", (F.col("action") == "like").alias("a"), "ts", "event_id")
    plan = ordered.ranged(rows, ["user_id", "comment_id"], ["ts", "event_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan
    walked = chg._like_walk(e, ["user_id", "comment_id"], ["ts", "event_id"])
    assert "rangepartitioning" not in walked._jdf.queryExecution().executedPlan().toString()
    assert walked.count() == e.select("user_id", "comment_id").distinct().count()


def test_only_borders_are_chained(spark, many_partitions):
    rows = spark.createDataFrame([(i % 200, i, 1) for i in range(3000)], "id long, seq long, delta long")

    def summarise(batch, starts):
        import numpy as np

        return {"s": np.diff(np.append(starts, batch.num_rows)).astype(np.int64)}

    done, edges = ordered.reduce_in_place(
        ordered.ranged(rows, ["id"], ["seq"]), ["id"], summarise, lambda a, b: {**a, "s": a["s"] + b["s"]}, "s long", "test"
    )
    assert edges.count() <= 2 * 17 and done.count() + edges.select("id").distinct().count() == 200
    total = done.select("id", "s").unionByName(edges.select("id", "s")).groupBy("id").agg(F.sum("s").alias("s"))
    assert {r["s"] for r in total.collect()} == {15}


@pytest.mark.parametrize("seed", range(3))
def test_running_totals(spark, many_partitions, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 7, 7, 7, rng.randrange(30)]), k, rng.randrange(-5, 9)) for k in range(800)]
    want, sums = {}, {}
    for g, k, v in rows:
        want[k] = sums.get(g, 0)
        sums[g] = want[k] + v
    rng.shuffle(rows)
    got = ordered.running_totals(spark.createDataFrame(rows, "g long, k long, v long"), ["g"], ["k"], "v", "before")
    assert {r["k"]: r["before"] for r in got.collect()} == want
    assert got.columns == ["g", "k", "v", "before"]


def test_running_max(spark, many_partitions):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, rng.randrange(1000)])) for k in range(500)]
    want, top = {}, None
    for k, v in rows:
        top = v if top is None else top if v is None else max(top, v)
        want[k] = top
    rng.shuffle(rows)
    got = ordered.running_max(spark.createDataFrame(rows, "k long, v long"), ["k"], "v", "top")
    assert {r["k"]: r["top"] for r in got.collect()} == want
    assert ordered.running_max(spark.createDataFrame([], "k long, v long"), ["k"], "v", "top").isEmpty()
