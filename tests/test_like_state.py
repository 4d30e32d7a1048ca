"""Keyed like state: equal to the batch replay, late events, restarts."""

import datetime as dt
import os
import random
import tempfile

import pytest

from contentlens.operators.changes import apply_like_events, like_event_outcomes
from contentlens.streaming import LIKE_EVENT_SCHEMA, like_event_source
from contentlens.streaming.like_state import settled_counts, settled_likes, start_like_state

T0 = dt.datetime(2024, 1, 1)
#: Pushes the watermark past all events.
LAST = (10**6, T0 + dt.timedelta(days=30), -1, -1, "like")
LIKES = "user_id bigint, comment_id bigint, created_at timestamp_ntz"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def folders():
    return [tempfile.mkdtemp(prefix=f"like-state-{p}-") for p in ("src", "out", "ckpt")]


def feed(spark, src, name, events):
    spark.createDataFrame(events, LIKE_EVENT_SCHEMA).coalesce(1).write.parquet(f"{src}/{name}")


def run(spark, src, out, ckpt, likes, files=1):
    q = start_like_state(like_event_source(spark, f"{src}/*", files), out, ckpt, likes=likes, available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None


def table(df):
    return sorted((r["user_id"], r["comment_id"], r["created_at"]) for r in df.collect() if r["user_id"] >= 0)


def test_equals_batch_replay_with_late_events_and_restart(spark):
    src, out, ckpt = folders()
    rng = random.Random(4)
    events = [(i, T0 + dt.timedelta(seconds=20 * i), rng.randrange(4), rng.randrange(3), rng.choice(["like", "unlike", "like", "poke"])) for i in range(120)]
    likes = spark.createDataFrame([(0, 0, T0 - dt.timedelta(days=2)), (1, 1, T0 - dt.timedelta(days=1)), (77, 1, T0 - dt.timedelta(days=1))], LIKES)
    # arrival order is off by up to ten events (200 s), the delay is ten minutes
    arrival = sorted(events, key=lambda e: e[0] + rng.randrange(10))
    assert arrival != events
    feed(spark, src, "f0", arrival[:40])
    feed(spark, src, "f1", arrival[40:80])
    run(spark, src, out, ckpt, likes)
    # the job stops and a new one goes on from its checkpoint
    feed(spark, src, "f2", arrival[80:])
    feed(spark, src, "f3", [LAST])
    run(spark, src, out, ckpt, likes)
    log = spark.createDataFrame(events, LIKE_EVENT_SCHEMA)
    assert table(settled_likes(spark, out, likes)) == table(apply_like_events(likes, log))
    want = {}
    for r in like_event_outcomes(likes, log).collect():
        a, b = want.get(r["comment_id"], (0, 0))
        want[r["comment_id"]] = (a + r["accepted"], b + r["rejected"])
    got = {r["comment_id"]: (r["accepted"], r["rejected"]) for r in settled_counts(spark, out).collect() if r["comment_id"] >= 0}
    assert got == want
    before, after = ({}, {})
    for n, rows in ((before, table(likes)), (after, table(apply_like_events(likes, log)))):
        for _, c, _ in rows:
            n[c] = n.get(c, 0) + 1
    change = {r["comment_id"]: r["like_count_change"] for r in settled_counts(spark, out).collect() if r["comment_id"] >= 0}
    assert change == {c: after.get(c, 0) - before.get(c, 0) for c in change}


def test_a_batch_writes_its_own_pairs_only(spark):
    src, out, ckpt = folders()
    many = [(i, T0 + dt.timedelta(seconds=i), i, 1, "like") for i in range(50)]
    feed(spark, src, "f0", many)
    feed(spark, src, "f1", [(100, T0 + dt.timedelta(hours=5), 7, 1, "unlike"), (101, T0 + dt.timedelta(hours=5), 8, 1, "like")])
    feed(spark, src, "f2", [LAST])
    likes = spark.createDataFrame([], LIKES)
    run(spark, src, out, ckpt, likes)
    sizes = {}
    for name in os.listdir(out):
        rows = [r for r in spark.read.parquet(f"{out}/{name}").collect() if r["user_id"] >= 0]
        sizes[len(rows)] = [(r["user_id"], r["liked"], r["accepted"], r["rejected"]) for r in rows]
    assert {n for n in sizes if n} == {50, 2}
    assert sorted(sizes[2]) == [(7, False, 1, 0), (8, True, 0, 1)]
    assert len(table(settled_likes(spark, out, likes))) == 49
