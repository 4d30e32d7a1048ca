"""Batches against a one-by-one replay: V1, V2, W1, W2, W9; text keys."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from frames import comment, post, tables, user
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from contentlens.operators import changes as chg
from contentlens.operators import quality as qa
from contentlens.sources.tables import conform

SLOW = dict(deadline=None, suppress_health_check=list(HealthCheck))
EMAILS = ["a@x.org", "b@x.org", "c@x.org", "bad", None]
NAMES = ["anna", "bert", "carl", "x", None]


@settings(max_examples=12, **SLOW)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(EMAILS), st.sampled_from(NAMES)), max_size=10))
def test_users_replay(spark, rows):
    batch = [(i, s, e, n) for i, (s, e, n) in enumerate(rows)]
    stored_e, stored_n = {"c@x.org"}, {"carl"}
    emails, names, want = set(), set(), {}
    for i, s, e, n in sorted(batch, key=lambda r: (r[1], r[0])):
        reasons = []
        if e is None or e == "bad":
            reasons.append("email_invalid")
        if n is None or n == "x":
            reasons.append("username_length")
        if e in stored_e | emails:
            reasons.append("email_taken")
        if n in stored_n | names:
            reasons.append("username_taken")
        want[i] = reasons
        if not reasons:
            emails.add(e)
            names.add(n)
    df = spark.createDataFrame(batch, "id bigint, seq int, email string, username string")
    users = spark.createDataFrame([("c@x.org", "carl")], "email string, username string")
    got = {r["id"]: r["reasons"] for r in qa.validate_users(df, users, order=("seq", "id")).collect()}
    assert got == want


def test_users_with_one_seq_are_not_both_accepted(spark):
    df = spark.createDataFrame([(1, "a@x.org", "anna"), (1, "a@x.org", "bert")], "seq int, email string, username string")
    none = spark.createDataFrame([], "email string, username string")
    reasons = sorted(r["reasons"] for r in qa.validate_users(df, none).collect())
    assert reasons == [[], ["email_taken"]]


def test_rejected_category_claims_nothing(spark):
    cats = spark.createDataFrame([(1, "root", "root", None)], "id int, name string, slug string, parent_id int")
    rows = [(5, 1, "", "news", None), (6, 2, "News", "news", None), (7, 3, "More", "news", 1), (8, 4, "Loop", "loop", 8), (9, 5, "Next", "loop", 1)]
    batch = spark.createDataFrame(rows, "id int, seq int, name string, slug string, parent_id int")
    got = {r["id"]: r["reasons"] for r in qa.validate_categories(batch, cats).collect()}
    assert got == {5: ["name_length"], 6: [], 7: ["slug_taken"], 8: ["parent_cycle"], 9: []}


def test_missing_id_fails(spark):
    t = tables(spark, users=[user(1)])
    new = spark.createDataFrame([("z@x.org", "zed")], "email string, username string")
    with pytest.raises(PySparkException):
        chg.insert_rows(t.users, new, "users", "2024-02-01 00:00:00").collect()


CHANGES = "id bigint, seq int, status string, title string"


@settings(max_examples=10, **SLOW)
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from(["draft", "archived", None]), st.sampled_from(["T", "U", None])), max_size=8))
def test_several_changes_fold_to_the_last(spark, rows):
    posts = [post(i, 1, title=f"p{i}") for i in (1, 2, 3)]
    t = tables(spark, posts=posts)
    changes = [(i, seq, s, title) for seq, (i, s, title) in enumerate(rows)]
    df = spark.createDataFrame(changes, CHANGES)
    replace = {i: ("published", f"p{i}") for i in (1, 2, 3)}
    merge = dict(replace)
    for i, _, s, title in changes:
        replace[i] = (s or replace[i][0], title)
        merge[i] = (s or merge[i][0], title or merge[i][1])
    for how, want in ((chg.update_replace, replace), (chg.update_merge, merge)):
        got = {r["id"]: (r["status"], r["title"]) for r in how(t.posts, df, "2024-02-01 00:00:00", order="seq").collect()}
        assert got == want
    if len({i for i, *_ in changes}) < len(changes):
        with pytest.raises(PySparkException):
            chg.update_replace(t.posts, df.drop("seq"), "2024-02-01 00:00:00").collect()


def test_other_deltas_and_actions(spark):
    t = tables(spark, users=[user(1)], comments=[comment(1, 1, 7, likes=3)])
    bad = spark.createDataFrame([(1, 1, 2)], "id bigint, seq int, delta int")
    with pytest.raises(PySparkException):
        chg.counter_after_deltas(t.comments, bad).collect()
    ev = spark.createDataFrame(
        [(1, 1, "like", dt.datetime(2024, 1, 1), 1), (1, 1, "poke", dt.datetime(2024, 1, 2), 2)],
        "user_id bigint, comment_id bigint, action string, ts timestamp_ntz, event_id bigint",
    )
    (r,) = chg.like_event_outcomes(t.comment_likes, ev).collect()
    assert (r["liked"], r["accepted"], r["rejected"]) == (True, 1, 0)


def test_text_keys_end_to_end(spark):
    """UUID-like keys through conform, hierarchies, updates, validation and deletes."""
    from contentlens.operators import hierarchy as hier
    from contentlens.operators import users as usr

    def text(df, *cols):
        return df.withColumns({c: F.concat(F.lit("k-"), F.col(c).cast("string")) for c in cols})

    n = tables(
        spark, users=[user(1), user(2)], cats=[(10, "c", "c", None, 0), (11, "d", "d", 10, 1), (12, "e", "e", 11, 2)],
        posts=[post(100, 1, cat=11), post(101, 2, cat=12)],
        comments=[comment(1000, 2, 100), comment(1001, 1, 100, parent=1000), comment(1002, 2, 101)],
        likes=[(1, 1002, dt.datetime(2024, 1, 1)), (2, 1001, dt.datetime(2024, 1, 1))],
    )
    t = n.with_(
        users=conform(text(n.users, "id"), "users"), categories=conform(text(n.categories, "id", "parent_id"), "categories"),
        posts=conform(text(n.posts, "id", "author_id", "category_id"), "posts"),
        comments=conform(text(n.comments, "id", "author_id", "post_id", "parent_id"), "comments"),
        comment_likes=conform(text(n.comment_likes, "user_id", "comment_id"), "comment_likes"),
    )
    assert t.users.schema["id"].dataType.typeName() == "string"
    assert [r["id"] for r in hier.ancestors(t.categories, "k-11").collect()] == ["k-10"]
    assert sorted(r["id"] for r in hier.descendants(t.categories, "k-10").collect()) == ["k-11", "k-12"]
    left, counts = chg.cascade_delete(t, "users", t.users.where("id = 'k-1'").select("id"))
    assert {r["table_name"]: r["removed"] for r in counts.collect()} == {"users": 1, "categories": 0, "posts": 1, "comments": 2, "comment_likes": 2}
    assert [r["id"] for r in left.comments.collect()] == ["k-1002"]
    left, _ = chg.cascade_delete(t, "categories", t.categories.where("id = 'k-11'").select("id"))
    assert {r["id"]: r["parent_id"] for r in left.categories.collect()} == {"k-10": None, "k-12": None}
    assert {r["id"]: r["category_id"] for r in left.posts.collect()} == {"k-100": None, "k-101": "k-12"}
    (zero,) = usr.user_engagement(t.users, t.posts, t.comments, "2024-01-31 00:00:00", user_id="nobody").collect()
    assert zero["user_id"] == "nobody" and zero["total_posts"] == 0
    out = chg.set_status(t.posts, t.posts.where("id = 'k-100'").select("id"), "archived", "2024-02-01 00:00:00")
    assert {r["id"]: r["status"] for r in out.collect()} == {"k-100": "archived", "k-101": "published"}
    new = chg.insert_rows(t.users, spark.createDataFrame([("z@x.org", "zed")], "email string, username string"), "users", "2024-02-01 00:00:00")
    assert new.where("id IS NULL").count() == 0 and new.count() == 3
    checked = qa.validate_comments(t.comments, t.posts, t.comments)
    assert all(not r["reasons"] for r in checked.collect())
