"""Change appliers: like replay (W3), counter replay (W9), cascade (W5), updates."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import rows
from frames import D, comment, post, tables, user

from contentlens.operators import changes as chg
from contentlens.operators import comments as com

EVENTS = "event_id long, ts timestamp_ntz, user_id long, comment_id long, action string"
DELTAS = "id long, seq long, delta int"


def replay_likes(stored, events):
    """Sequential replay: returns {pair: (liked, accepted, rejected)}."""
    state, out = {}, {}
    for eid, ts, u, c, action in sorted(events, key=lambda e: (e[1], e[0])):
        key = (u, c)
        liked = state.get(key, key in stored)
        want = action == "like"
        acc, rej = out.get(key, (None, 0, 0))[1:]
        if liked != want:
            acc += 1
        else:
            rej += 1
        state[key] = want
        out[key] = (want, acc, rej)
    return out


def test_like_log_example(spark):
    ev = [(i, D(2024, 1, 1, i), 1, 9, a) for i, a in enumerate(["like", "like", "unlike", "unlike", "like"])]
    likes = spark.createDataFrame([], "user_id long, comment_id long, created_at timestamp_ntz")
    out = chg.like_event_outcomes(likes, spark.createDataFrame(ev, EVENTS)).collect()
    assert [(r["liked"], r["accepted"], r["rejected"], r["liked_since"]) for r in out] == [(True, 3, 2, D(2024, 1, 1, 4))]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.sampled_from(["like", "unlike"])), min_size=1, max_size=40),
    st.sets(st.tuples(st.integers(0, 2), st.integers(0, 1)), max_size=3),
)
def test_like_replay_matches_sequential(spark, evs, stored):
    events = [(i, D(2024, 1, 1) + dt.timedelta(minutes=i), u, c, a) for i, (u, c, a) in enumerate(evs)]
    likes = spark.createDataFrame([(u, c, D(2023, 1, 1)) for u, c in stored], "user_id long, comment_id long, created_at timestamp_ntz")
    # 3 shuffle partitions, no coalescing: a pair's events span several ordered segments
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["user_id"], r["comment_id"]): (r["liked"], r["accepted"], r["rejected"])
               for r in chg.like_event_outcomes(likes, spark.createDataFrame(events, EVENTS)).collect()}
        nxt = {(r["user_id"], r["comment_id"]) for r in chg.apply_like_events(likes, spark.createDataFrame(events, EVENTS)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = replay_likes(stored, events)
    assert got == want
    final = {k for k in stored if k not in want} | {k for k, v in want.items() if v[0]}
    assert nxt == final


def replay_counter(c0, deltas):
    v = c0
    for d in deltas:
        v = max(0, v + d)
    return v


def test_counter_example(spark):
    table = spark.createDataFrame([(1, 0), (2, 5)], "id long, like_count int")
    deltas = spark.createDataFrame([(1, 1, -1), (1, 2, 1)], DELTAS)
    out = {r["id"]: (r["old"], r["new"]) for r in chg.counter_after_deltas(table, deltas).collect()}
    assert out == {1: (0, 1), 2: (5, 5)}


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.sampled_from([-1, 1])), max_size=50), st.lists(st.integers(0, 3), min_size=3, max_size=3))
def test_counter_replay_matches_sequential(spark, ds, starts):
    table = spark.createDataFrame([(i, s) for i, s in enumerate(starts)], "id long, like_count int")
    deltas = spark.createDataFrame([(i, seq, d) for seq, (i, d) in enumerate(ds)], DELTAS)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["id"]: r["like_count"] for r in chg.apply_counter_deltas(table, deltas).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {i: replay_counter(s, [d for j, d in ds if j == i]) for i, s in enumerate(starts)}
    assert got == want


def world(spark):
    return tables(
        spark,
        users=[user(1), user(2), user(3)],
        cats=[(10, "a", "a", None, 0), (11, "b", "b", 10, 0), (12, "c", "c", None, 1)],
        posts=[post(100, 1, cat=10), post(101, 2, cat=11), post(102, 2, cat=None)],
        comments=[comment(1, 2, 100), comment(2, 3, 101, parent=None), comment(3, 1, 101, parent=2),
                  comment(4, 2, 101, parent=3), comment(5, 3, 102)],
        likes=[(1, 2, D(2024, 1, 7)), (2, 5, D(2024, 1, 7)), (3, 1, D(2024, 1, 7)), (3, 4, D(2024, 1, 7))],
    )


def no_dangling(t):
    users = {r["id"] for r in t.users.collect()}
    posts = {r["id"]: r for r in t.posts.collect()}
    comments = {r["id"]: r for r in t.comments.collect()}
    cats = {r["id"] for r in t.categories.collect()}
    assert all(p["author_id"] in users for p in posts.values())
    assert all(p["category_id"] is None or p["category_id"] in cats for p in posts.values())
    assert all(c["author_id"] in users and c["post_id"] in posts for c in comments.values())
    assert all(c["parent_id"] is None or c["parent_id"] in comments for c in comments.values())
    assert all(r["user_id"] in users and r["comment_id"] in comments for r in t.comment_likes.collect())


def test_cascade_delete_user(spark):
    nxt, counts = chg.cascade_delete(world(spark), "users", spark.createDataFrame([(1,)], "id long"))
    c = {r["table_name"]: r["removed"] for r in counts.collect()}
    # user 1 -> post 100 -> comment 1; comment 3 (by 1) -> reply 4;
    # likes (1, 2) by user 1, (3, 1) and (3, 4) on deleted comments
    assert c == {"users": 1, "categories": 0, "posts": 1, "comments": 3, "comment_likes": 3}
    assert sorted(r["id"] for r in nxt.comments.collect()) == [2, 5]
    no_dangling(nxt)


def test_cascade_delete_category_sets_null(spark):
    nxt, counts = chg.cascade_delete(world(spark), "categories", spark.createDataFrame([(10,)], "id long"))
    assert {r["table_name"]: r["removed"] for r in counts.collect()}["categories"] == 1
    assert {r["id"]: r["parent_id"] for r in nxt.categories.collect()} == {11: None, 12: None}
    assert {r["id"]: r["category_id"] for r in nxt.posts.collect()} == {100: None, 101: 11, 102: None}
    no_dangling(nxt)


def test_insert_defaults_and_updates(spark):
    t = world(spark)
    new = spark.createDataFrame([(103, "t", "c", 3)], "id long, title string, content string, author_id long")
    posts = chg.insert_rows(t.posts, new, "posts", "2024-02-01 00:00:00")
    r = posts.where("id = 103").first()
    assert (r["status"], r["view_count"], r["like_count"], r["allow_comments"], r["tags"]) == ("draft", 0, 0, True, [])
    assert r["created_at"] == D(2024, 2, 1) and r["updated_at"] is None
    ch = spark.createDataFrame([(100, "new", None)], "id long, title string, status string")
    up = chg.update_replace(posts, ch, "2024-02-02 00:00:00").where("id = 100").first()
    assert (up["title"], up["status"], up["updated_at"]) == ("new", "published", D(2024, 2, 2))
    cats = chg.update_merge(t.categories, spark.createDataFrame([(11, None, 7)], "id int, name string, order int"), "2024-02-02")
    got = {r["id"]: (r["name"], r["order"]) for r in cats.collect()}
    assert got[11] == ("b", 7)
    ed = chg.edit_comments(t.comments, spark.createDataFrame([(1, "edited")], "id long, content string"), "2024-02-03")
    e = ed.where("id = 1").first()
    assert (e["content"], e["is_edited"]) == ("edited", True)


def test_delete_likes_and_category_rejects(spark):
    t = world(spark)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "user_id long, comment_id long")
    likes, report = chg.delete_likes(t.comment_likes, pairs)
    assert rows(report) == [(1, 2, True), (1, 3, False)]
    assert likes.count() == 3
    rej = chg.category_delete_rejects(t.categories, spark.createDataFrame([(10,), (12,)], "id int"))
    assert [r["id"] for r in rej.collect()] == [10]


def test_like_count_drift_and_reconcile(spark):
    t = world(spark)
    drift = {r["id"]: r["drift"] for r in com.like_count_drift(t.comments, t.comment_likes).collect()}
    assert drift == {1: -1, 2: -1, 4: -1, 5: -1}  # stored counts are 0, each has one like
    fixed = {r["id"]: r["like_count"] for r in com.reconcile_like_counts(t.comments, t.comment_likes).collect()}
    assert fixed == {1: 1, 2: 1, 3: 0, 4: 1, 5: 1}


def test_apply_like_events_created_at(spark):
    likes = spark.createDataFrame(
        [(1, 1, D(2023, 1, 1)), (2, 2, D(2023, 1, 1)), (3, 3, D(2023, 1, 1))],
        "user_id long, comment_id long, created_at timestamp_ntz",
    )
    ev = [
        (1, D(2024, 1, 2), 1, 1, "unlike"), (2, D(2024, 1, 3), 1, 1, "like"),   # re-inserted at Jan 3
        (3, D(2024, 1, 5), 2, 2, "like"),                                        # rejected: stays 2023
        (4, D(2024, 1, 1), 4, 4, "like"), (5, D(2024, 1, 2), 4, 4, "like"),      # new at Jan 1
        (6, D(2024, 1, 1), 3, 3, "unlike"),                                      # removed
        (7, D(2024, 1, 1), 5, 5, "like"), (8, D(2024, 1, 2), 5, 5, "unlike"),
        (9, D(2024, 1, 4), 5, 5, "unlike"), (10, D(2024, 1, 6), 5, 5, "like"),   # new at Jan 6
    ]
    nxt = chg.apply_like_events(likes, spark.createDataFrame(ev, EVENTS))
    got = {(r["user_id"], r["comment_id"]): r["created_at"] for r in nxt.collect()}
    assert got == {(1, 1): D(2024, 1, 3), (2, 2): D(2023, 1, 1), (4, 4): D(2024, 1, 1), (5, 5): D(2024, 1, 6)}


def test_insert_string_ids_get_uuids(spark):
    table = spark.createDataFrame(
        [("a", "x", None, 0, D(2024, 1, 1), None)],
        "id string, name string, parent_id string, `order` int, created_at timestamp_ntz, updated_at timestamp_ntz",
    )
    rows_in = spark.createDataFrame([(None, "new"), ("given", "kept")], "id string, name string")
    out = chg.insert_rows(table, rows_in, "categories", "2024-02-01 00:00:00").collect()
    ids = {r["name"]: r["id"] for r in out}
    assert ids["kept"] == "given" and len(ids["new"]) == 36 and ids["new"] != ids["kept"]
    assert {r["name"]: r["order"] for r in out}["new"] == 0  # model default
