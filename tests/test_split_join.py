"""Hot keys are split off a join, without adaptive execution."""

import random

import pytest
from pyspark.sql import functions as F

from contentlens.operators import filters as flt
from contentlens.operators import quality as qa
from contentlens.operators.skew import hot_keys, split_left_join
from contentlens.sources.fixtures import comment_likes_view
from frames import comment, post, tables


@pytest.fixture
def not_adaptive(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.fixture
def one_partition(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_equals_a_plain_join(spark):
    rng = random.Random(1)
    keys = [7] * 400 + [None] * 50 + [rng.randrange(60) for _ in range(150)]
    left = spark.createDataFrame(list(enumerate(keys)), "i int, k int")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(40)], "id int, v string")
    want = left.join(right, F.col("k") == F.col("id"), "left")
    assert rows_of(split_left_join(left, right, "k", "id")) == rows_of(want)
    assert [r["k"] for r in hot_keys(left, "k").collect()] == [7]
    assert rows_of(split_left_join(left.limit(0), right, "k", "id")) == []


def test_no_task_gets_the_hot_key(spark, not_adaptive):
    # 90 % of the rows on one post
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") + 5).alias("post_id"), F.spark_partition_id().alias("p"))
    posts = spark.range(1, 30_000).select(F.col("id").alias("pid"), F.lit(True).alias("allow"))
    out = split_left_join(rows.repartition(16), posts, "post_id", "pid").groupBy(F.spark_partition_id().alias("t")).count()
    sizes = sorted(r["count"] for r in out.collect())
    assert sum(sizes) == 20_000 and sizes[-1] < 3 * max(1, sizes[len(sizes) // 2])


def test_hot_post_in_the_operators(spark):
    posts = [post(1, 1, status="draft", allow=False), post(2, 2), post(3, 3, status="archived")]
    comments = [comment(i, 1, 1 if i % 10 else 2, parent=None if i % 3 else 5) for i in range(300)]
    t = tables(spark, posts=posts, comments=comments)
    batch = t.comments.withColumn("id", F.col("id") + 1000)
    plain, split = (qa.validate_comments(batch, t.posts, t.comments, split_hot=s).select("id", "reasons") for s in (False, True))
    assert rows_of(plain) == rows_of(split)
    req = spark.createDataFrame([(i, i % 4, 1 if i % 10 else i % 5, "admin" if i % 7 == 0 else "user") for i in range(200)],
                                "request_id int, viewer_id bigint, post_id bigint, viewer_role string")
    plain, split = (flt.visibility_of_requests(t.posts, req, split_hot=s) for s in (False, True))
    assert rows_of(plain) == rows_of(split)


def per_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("t")).count().collect()]


def test_tasks_of_the_join_follow_the_rows(spark, one_partition):
    # a fifth of the rows on one key, which is hot only among more partitions than the session's one
    rows = spark.range(2_000_000).select("id", F.when(F.col("id") % 5 == 0, 7).otherwise(F.col("id") % 50_000).alias("k"))
    table = spark.range(40_000).select(F.col("id").alias("tid"), (F.col("id") * 3).alias("v"))
    out = split_left_join(rows, table, "k", "tid")
    sizes = per_task(out)
    assert sum(sizes) == 2_000_000 and max(sizes) < 1_000_000
    assert [r["k"] for r in hot_keys(rows, "k").collect()] == [7]
    said = [F.count("v"), F.sum("v"), F.sum(F.col("id") * F.col("v"))]
    assert out.agg(*said).first() == rows.join(table, F.col("k") == F.col("tid"), "left").agg(*said).first()


def test_tasks_of_the_likes_follow_the_rows(spark, one_partition):
    raw = spark.range(2_000_000).select(
        (F.col("id") % 1_000).alias("user_id"), (F.col("id") % 1_900_000).alias("comment_id"),
        F.timestamp_seconds("id").alias("created_at"))
    likes = comment_likes_view(raw, spark.range(990), spark.range(1, 3_000_000))
    sizes = per_task(likes)
    # no user 990 to 999, no comment 0, requests of 1,900,000 on repeat those of the first 100,000
    assert sum(sizes) == 1_900_000 * 99 // 100 - 1 and max(sizes) < 1_000_000
    assert likes.where(F.col("comment_id") == 5).select("user_id", F.unix_timestamp("created_at")).collect() == [(5, 5)]
