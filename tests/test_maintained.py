"""Maintained statistics equal a full recompute after every batch."""

import datetime as dt
import random

import pytest
from frames import comment, post, tables, user
from pyspark.sql import functions as F

from contentlens.operators import categories as cat
from contentlens.operators import comments as com
from contentlens.operators import maintained as mt
from contentlens.operators import posts as pst
from contentlens.operators import users as usr

AS_OF = "2024-03-01 00:00:00"
DAY = dt.datetime(2024, 1, 1)


def rows_of(df):
    return sorted(map(str, (sorted(r.asDict().items()) for r in df.collect())))


def random_post(rng, i):
    return post(i, rng.randrange(6), status=rng.choice(["draft", "published", "archived"]), cat=rng.choice([None, 1, 2, 3]), views=rng.randrange(50),
                likes=rng.randrange(9), updated=rng.choice([None, DAY + dt.timedelta(days=rng.randrange(40))]))


def random_comment(rng, i, posts):
    return comment(i, rng.randrange(7), rng.choice(posts), parent=rng.choice([None, 1]), likes=rng.randrange(5),
                   updated=rng.choice([None, DAY + dt.timedelta(days=rng.randrange(40))]))


def check(s, t):
    pairs = [
        (mt.author_stats(s, t.users), pst.author_stats(t.users, t.posts, t.comments)),
        (mt.comment_stats_by_author(s, t.users), com.comment_stats_by_author(t.users, t.comments)),
        (mt.category_stats(s, t.categories), cat.category_stats(t.categories, t.posts, t.comments)),
        (mt.category_stats(s, t.categories, "literal"), cat.category_stats(t.categories, t.posts, t.comments, "literal")),
        (mt.user_engagement(s, t.users, AS_OF), usr.user_engagement(t.users, t.posts, t.comments, AS_OF)),
    ]
    for got, want in pairs:
        assert rows_of(got) == rows_of(want)
    fresh = mt.build(t.posts, t.comments)
    for name in ("posts", "authors", "commenters", "categories"):
        own, want = getattr(s, name), getattr(fresh, name)
        assert rows_of(own.select(sorted(own.columns))) == rows_of(want.select(sorted(want.columns))), name


def test_batches_equal_a_recompute(spark, tmp_path):
    rng = random.Random(11)
    users, cats = [user(i) for i in range(8)], [(i, f"c{i}", f"c{i}", None, 0) for i in range(1, 5)]
    posts = {i: random_post(rng, i) for i in range(20)}
    comments = {i: random_comment(rng, i, list(posts)) for i in range(60)}
    t = tables(spark, users=users, cats=cats, posts=posts.values(), comments=comments.values())
    s = mt.build(t.posts, t.comments).stored()
    for step in range(2):
        old = t
        gone = set(rng.sample(sorted(posts), 3))
        ids_p = set(gone) | set(rng.sample(sorted(posts), 4))
        posts = {i: p for i, p in posts.items() if i not in gone}
        for i in ids_p - gone:
            posts[i] = random_post(rng, i)
        for i in range(100 * (step + 1), 100 * (step + 1) + 4):
            posts[i] = random_post(rng, i)
            ids_p.add(i)
        ids_c = {i for i, c in comments.items() if c[3] in gone} | set(rng.sample(sorted(comments), 8))
        comments = {i: c for i, c in comments.items() if c[3] not in gone}
        for i in sorted(ids_c & set(comments)):
            if rng.random() < 0.5:
                del comments[i]
            else:
                comments[i] = random_comment(rng, i, sorted(posts))
        for i in range(1000 * (step + 1), 1000 * (step + 1) + 9):
            comments[i] = random_comment(rng, i, sorted(posts))
            ids_c.add(i)
        t = tables(spark, users=users, cats=cats, posts=posts.values(), comments=comments.values())
        frames = [spark.createDataFrame([(i,) for i in ids], "id bigint") for ids in (ids_p, ids_c)]
        s = mt.refresh(s, mt.images(old.posts, t.posts, frames[0]), mt.images(old.comments, t.comments, frames[1]), t.comments)
        check(s, t)
    s.save(str(tmp_path / "s"))
    assert rows_of(mt.Summaries.load(spark, str(tmp_path / "s")).authors) == rows_of(s.authors)


def test_empty_batch_and_empty_tables(spark):
    t = tables(spark, users=[user(1)], cats=[(1, "c", "c", None, 0)], posts=[post(1, 1, cat=1)], comments=[comment(1, 1, 1)])
    none = tables(spark)
    s = mt.build(none.posts, none.comments).stored()
    first = mt.refresh(s, mt.Change(none.posts, t.posts), mt.Change(none.comments, t.comments), t.comments)
    same = mt.refresh(first, mt.Change(none.posts, none.posts), mt.Change(none.comments, none.comments), t.comments)
    check(same, t)
    last = mt.refresh(same, mt.Change(t.posts, none.posts), mt.Change(t.comments, none.comments), none.comments)
    assert last.authors.isEmpty() and last.categories.isEmpty() and last.commenters.isEmpty() and last.posts.isEmpty()


def test_latest_update_goes_back_when_its_row_goes(spark):
    day = lambda n: DAY + dt.timedelta(days=n)
    before = tables(spark, users=[user(1)], posts=[post(1, 1, updated=day(5)), post(2, 1, updated=day(9)), post(3, 1, updated=day(9))])
    s = mt.build(before.posts, before.comments).stored()
    ids = spark.createDataFrame([(2,), (3,)], "id bigint")
    after = tables(spark, users=[user(1)], posts=[post(1, 1, updated=day(5)), post(2, 1, updated=None)])
    got = mt.refresh(s, mt.images(before.posts, after.posts, ids), mt.images(before.comments, after.comments, ids), after.comments)
    assert got.authors.select("last_update").first()[0] == day(5)
    assert got.authors.where(F.col("n") == 2).count() == 1
