"""Lookups, listings, visibility and paging."""

import pytest
from conftest import rows
from frames import D, post, tables, user

from contentlens.functions.visibility import Viewer
from contentlens.operators import filters as flt


@pytest.fixture()
def t(spark):
    return tables(
        spark,
        users=[user(1), user(2), user(3, role="admin")],
        posts=[
            post(1, 1, "published", tags=["py", "spark"], title="Red 50% off", created=D(2024, 1, 1)),
            post(2, 1, "draft", tags=["py"], title="red_car", created=D(2024, 1, 2)),
            post(3, 2, "published", tags=[None, "spark"], title="Blue", created=D(2024, 1, 2)),
            post(4, 2, "archived", tags=[], title="REDWOOD", created=D(2024, 1, 3), featured=True),
            post(5, 1, "published", tags=None, title="green", created=D(2024, 1, 1)),
        ],
    )


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_lookup_forms(spark, t):
    assert ids(flt.by_id(t.posts, 3)) == [3]
    assert ids(flt.by_id(t.posts, [1, 4, 99])) == [1, 4]
    keys = spark.createDataFrame([(2,), (5,), (2,)], "id bigint")
    assert ids(flt.lookup(t.posts, keys)) == [2, 5]
    assert ids(flt.by_email(t.users, "u2@x.org")) == [2]
    assert ids(flt.by_email(t.users, "U2@x.org")) == []  # case-sensitive


def test_search_title_ilike_keeps_wildcards(t):
    assert ids(flt.search_title(t.posts, "red")) == [1, 2, 4]
    assert ids(flt.search_title(t.posts, "d_c")) == [2]  # _ is a wildcard
    assert ids(flt.search_title(t.posts, "50%")) == [1]


def test_search_tag_null_element_and_null_array(t):
    assert ids(flt.search_tag(t.posts, "spark")) == [1, 3]
    assert ids(flt.search_tag(t.posts, "Spark")) == []
    assert ids(flt.search_tag(t.posts, "nothing")) == []


def test_listing_visibility(t):
    assert ids(flt.filter_posts(t.posts, None)) == [1, 3, 5]
    assert ids(flt.filter_posts(t.posts, None, status="draft")) == [1, 3, 5]  # anonymous pinned to published
    assert ids(flt.filter_posts(t.posts, Viewer(1))) == [1, 2, 5]
    assert ids(flt.filter_posts(t.posts, Viewer(3, "admin"))) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        flt.filter_posts(t.posts, Viewer(1), author_id=2)


def test_listing_filters_are_anded(t):
    assert ids(flt.filter_posts(t.posts, Viewer(3, "admin"), search="red", tag="py")) == [1, 2]
    assert ids(flt.filter_posts(t.posts, Viewer(3, "admin"), search="red", status="archived")) == [4]
    assert ids(flt.filter_posts(t.posts, Viewer(3, "admin"), author_id=2, tag="spark")) == [3]


def test_single_visibility(t):
    assert ids(flt.visible_posts_for(t.posts, None)) == [1, 3, 5]
    assert ids(flt.visible_posts_for(t.posts, Viewer(2))) == [1, 3, 4, 5]


def test_bulk_visibility(spark, t):
    req = spark.createDataFrame(
        [(None, None, 2), (1, "user", 2), (2, "user", 2), (3, "admin", 4), (None, None, 99)],
        "viewer_id bigint, viewer_role string, post_id bigint",
    )
    got = rows(flt.visibility_of_requests(t.posts, req), "viewer_id", "post_id", "found", "visible")
    assert got == [
        (None, 2, True, False), (None, 99, False, False), (1, 2, True, True), (2, 2, True, False), (3, 4, True, True)
    ]


def test_page_order_and_info(t):
    p1 = [r["id"] for r in flt.page(t.posts, 1, 2).collect()]
    p2 = [r["id"] for r in flt.page(t.posts, 2, 2).collect()]
    p3 = [r["id"] for r in flt.page(t.posts, 3, 2).collect()]
    assert (p1, p2, p3) == ([1, 5], [2, 3], [4])
    info = flt.page_info(t.posts, 1, 2).first()
    assert (info["total"], info["pages"]) == (5, 3)
    assert flt.page_info(t.posts.where("false"), 1, 10).first()["pages"] == 0
    with pytest.raises(ValueError):
        flt.page(t.posts, 0, 10)
    with pytest.raises(ValueError):
        flt.page(t.posts, 1, 101)


def test_respond_projection(t):
    out = flt.respond(t.posts, "post")
    assert out.columns[:3] == ["id", "title", "content"] and "excerpt" not in out.columns


def test_cluster_conf_follows_shuffled_bytes():
    from contentlens.session import MAX_SHUFFLE_PARTITIONS, cluster_conf

    c = cluster_conf(5 * 1024**4, 1000, 8)
    assert int(c["spark.sql.shuffle.partitions"]) == 20480
    assert int(cluster_conf(100 * 1024**4, 1000, 8)["spark.sql.shuffle.partitions"]) == MAX_SHUFFLE_PARTITIONS
    assert int(cluster_conf(10 * 1024**2, 10, 4)["spark.sql.shuffle.partitions"]) == 80


def test_page_after_matches_offset_pages(t):
    first = flt.page_after(t.posts, None, 2).collect()
    assert [r["id"] for r in first] == [1, 5]
    last = first[-1]
    second = flt.page_after(t.posts, (last["created_at"], last["id"]), 2)
    assert [r["id"] for r in second.collect()] == [r["id"] for r in flt.page(t.posts, 2, 2).collect()]


def test_lookup_plan_follows_the_type_of_the_keys(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS k")
    keys = list(range(0, 3000, 2))
    listed = flt.lookup(df, keys)
    framed = flt.lookup(df, spark.createDataFrame([(k,) for k in keys], "id bigint"))
    assert listed.count() == framed.count() == 1500
    assert "Join" not in listed._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in framed._jdf.queryExecution().executedPlan().toString()
    pairs = [(i, i % 7) for i in range(1200)] + [(4000, 99)]
    assert flt.lookup(df, pairs, ["id", "k"]).count() == 1200
    assert flt.lookup(df, [], ["id", "k"]).count() == 0

