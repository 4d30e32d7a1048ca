"""The fan-out ("literal") numbers against a plain Python count.

Written from the rule: an owner's result row counts one line for every pair
of a post and a comment that belong together; a post or comment without a
partner makes a line of its own.  Things are counted once, counters are added
once per line.
"""

import datetime as dt
import random

import pytest
from frames import comment, post, tables, user

from contentlens.operators import categories as cat
from contentlens.operators import hierarchy as hier
from contentlens.operators import timeseries as ts
from contentlens.operators import users as usr

AS_OF = "2024-01-31 00:00:00"
D = dt.datetime


@pytest.fixture(scope="module")
def data():
    rng = random.Random(8)
    cats = [(c, f"c{c}", f"c-{c}", None if c < 12 else rng.choice(range(10, c)), c) for c in range(10, 18)]
    posts = [
        dict(id=100 + i, author=rng.randrange(1, 7), cat=rng.choice([None, 10, 11, 12, 13]), views=rng.randrange(90), likes=rng.randrange(9),
             created=D(2024, 1, rng.randrange(1, 31), rng.randrange(24))) for i in range(30)
    ]
    talk = [
        dict(id=1000 + i, author=rng.randrange(1, 7), post_id=rng.choice([100, 101, 100 + rng.randrange(30)]), likes=rng.randrange(9),
             created=D(2024, 1, rng.randrange(1, 31), rng.randrange(24))) for i in range(60)
    ]
    return cats, posts, talk


@pytest.fixture(scope="module")
def t(spark, data):
    cats, posts, talk = data
    return tables(
        spark, users=[user(i) for i in range(1, 8)], cats=cats,
        posts=[post(p["id"], p["author"], cat=p["cat"], views=p["views"], likes=p["likes"], created=p["created"]) for p in posts],
        comments=[comment(c["id"], c["author"], c["post_id"], likes=c["likes"], created=c["created"]) for c in talk],
    )


def lines(posts, talk, belongs):
    """All (post, comment) lines; None stands for a missing partner."""
    out = [(p, c) for p in posts for c in talk if belongs(p, c)]
    out += [(p, None) for p in posts if not any(q is p for q, _ in out)]
    return out + [(None, c) for c in talk if not any(d is c for _, d in out)]


def add(rows, side, field):
    return sum(r[side][field] for r in rows if r[side])


def kinds(rows, side):
    return len({r[side]["id"] for r in rows if r[side]})


def test_categories(t, data):
    cats, posts, talk = data
    want = {}
    for c, *_ in cats:
        own = [p for p in posts if p["cat"] == c]
        rows = [r for r in lines(own, talk, lambda p, k: k["post_id"] == p["id"]) if r[0]]
        want[c] = (kinds(rows, 0), add(rows, 0, "views"), kinds(rows, 1), add(rows, 0, "likes"))

    def got(semantics):
        return {r["id"]: (r["posts"], r["views"], r["comments"], r["likes"])
                for r in cat.category_stats(t.categories, t.posts, t.comments, semantics).collect()}

    assert got("literal") == want != got("true")


def test_users(t, data):
    _, posts, talk = data
    want = {}
    for u in range(1, 8):
        rows = lines([p for p in posts if p["author"] == u], [c for c in talk if c["author"] == u], lambda p, k: True)
        want[u] = (kinds(rows, 0), kinds(rows, 1), add(rows, 1, "likes"), add(rows, 0, "likes"), add(rows, 0, "views"))

    def got(semantics):
        eng = usr.user_engagement(t.users, t.posts, t.comments, AS_OF, semantics).collect()
        return {r["user_id"]: (r["total_posts"], r["total_comments"], r["total_likes_given"], r["total_likes_received"], r["total_views_received"]) for r in eng}

    assert got("literal") == want != got("true")
    act = {r["id"]: (r["posts"], r["comments"], r["likes_given"], r["likes_received"])
           for r in usr.user_activity(t.users, t.posts, t.comments, "literal").collect()}
    assert act == {u: w[:4] for u, w in want.items()}


def days():
    return [dt.date(2024, 1, 1) + dt.timedelta(d) for d in range(31)]


def test_growth_by_day(t, data):
    cats, posts, talk = data
    own = [p for p in posts if p["cat"] is not None]
    rows = [r for r in lines(own, talk, lambda p, k: k["post_id"] == p["id"]) if r[0]]
    want = []
    for day in days():
        born = [r for r in rows if r[0]["created"].date() == day]
        said = [r for r in rows if r[1] and r[1]["created"].date() == day]
        want.append((str(day), kinds(born, 0), kinds(said, 1), add(born, 0, "views"), add(born, 0, "likes")))
    got = [tuple(r[c] for c in ("date", "new_posts", "new_comments", "new_views", "new_likes"))
           for r in ts.category_growth(t.categories, t.posts, t.comments, AS_OF, 30, "literal").collect()]
    assert got == want  # in the order of the days


def test_timeline(t, data):
    _, posts, talk = data
    want = []
    for day in days():
        rows = lines(
            [p for p in posts if p["author"] == 3 and p["created"].date() == day],
            [c for c in talk if c["author"] == 3 and c["created"].date() == day], lambda p, k: True,
        )
        want.append((str(day), kinds(rows, 0), kinds(rows, 1), add(rows, 1, "likes"), add(rows, 0, "likes")))
    one = ts.user_activity_timeline(t.users, t.posts, t.comments, AS_OF, 30, user_id=3, semantics="literal")
    cols = ("date", "posts", "comments", "likes_given", "likes_received")
    assert [tuple(r[c] for c in cols) for r in one.collect()] == want  # in the order of the days
    every = ts.user_activity_timeline(t.users, t.posts, t.comments, AS_OF, 30, semantics="literal")
    assert sorted(tuple(r[c] for c in cols) for r in every.where("user_id = 3").collect()) == want and every.count() == 7 * 31
    assert ts.user_activity_timeline(t.users, t.posts, t.comments, AS_OF, 30, user_id=10**9).count() == 0


def test_orders_by_group_key(t, data):
    from contentlens.operators import comments as com

    hours = [r["hour"] for r in com.comments_by_hour(t.comments).collect()]
    assert hours == sorted(hours) and len(hours) == len({c["created"].hour for c in data[2]})
    depths = [r["depth"] for r in hier.depth_stats(t.categories).collect()]
    assert depths == sorted(depths)
    dates = [r["date"] for r in ts.new_users_daily(t.users, AS_OF, 30).collect()]
    assert dates == [str(d) for d in days()]
