"""The five content tables as views over the driver's TPC-H-style tables.

The mapping is fixed (it defines the test data, see FIXTURES.md) and is the
same text the DuckDB oracle inlines, expressed with the DataFrame API.
Every view is lazy; reading only the columns a query needs is left to
Catalyst's column pruning, and filters reach the Parquet scan.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlens.session import dealt, task_parts
from contentlens.sources.tables import ContentTables

# Fixed values of the mapping.
USERS_EPOCH = "2023-12-01 00:00:00"
POSTS_EPOCH = "2024-01-01 00:00:00"
PART_KEY_MODULUS = 200  # posts.title comes from part o_orderkey % 200
COMMENT_POST_MODULUS = 200  # comments.post_id = (event_id * 7) % 200
REPLY_OFFSET = 200  # comments.parent_id = event_id - 200
AS_OF = "2024-01-31 00:00:00"


def _ts(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def _plus(ts: Column, days: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(days.cast("int"), hours.cast("int"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def users_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(
        k.alias("id"),
        F.concat(F.lit("user"), k.cast("string"), F.lit("@example.org")).alias("email"),
        F.col("c_name").alias("username"),
        F.when(k % 50 == 0, "admin").otherwise("user").alias("role"),
        (k % 17 != 0).alias("is_active"),
        (k % 3 == 0).alias("is_verified"),
        _plus(_ts(USERS_EPOCH), k % 60, k % 24).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def categories_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    null_int = F.lit(None).cast("int")
    regions = _read(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + 1000).alias("id"),
        F.col("r_name").alias("name"),
        F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("slug"),
        null_int.alias("parent_id"),
        F.col("r_regionkey").alias("order"),
    )
    nations = _read(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") + 2000).alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("slug"),
        (F.col("n_regionkey") + 1000).alias("parent_id"),
        F.col("n_nationkey").alias("order"),
    )
    suppliers = _read(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 3000).cast("int").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("slug"),
        (F.col("s_nationkey") + 2000).alias("parent_id"),
        F.col("s_suppkey").cast("int").alias("order"),
    )
    return regions.unionByName(nations).unionByName(suppliers)


def posts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("o_orderkey")
    # Only part keys in (-200, 200) can match o_orderkey % 200, so the part
    # side is bounded by 399 keys whatever the scale: a safe broadcast.
    part = (
        _read(spark, sf_dir, "part")
        .where((F.col("p_partkey") > -PART_KEY_MODULUS) & (F.col("p_partkey") < PART_KEY_MODULUS))
        .select("p_partkey", "p_name", "p_type")
    )
    orders = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    joined = orders.join(F.broadcast(part), (ok % PART_KEY_MODULUS) == F.col("p_partkey"))
    m10 = ok % 10
    category = (
        F.when(m10 == 0, F.lit(None).cast("int"))
        .when(m10 < 3, (1000 + ok % 5).cast("int"))
        .when(m10 < 6, (2000 + ok % 25).cast("int"))
        .otherwise((3000 + ok % 7).cast("int"))
    )
    created = _plus(_ts(POSTS_EPOCH), ok % 30, ok % 24)
    return joined.select(
        ok.alias("id"),
        F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_name", "p_type").alias("content"),
        F.col("o_custkey").alias("author_id"),
        F.when(F.col("o_orderstatus") == "F", "published")
        .when(F.col("o_orderstatus") == "O", "draft")
        .otherwise("archived")
        .alias("status"),
        F.when(ok % 11 == 0, F.array().cast("array<string>"))
        .otherwise(
            F.array(
                F.lower(F.substring("o_orderpriority", 3, 1 << 30)),
                F.concat(F.lit("st-"), F.lower("o_orderstatus")),
            )
        )
        .alias("tags"),
        category.alias("category_id"),
        F.floor("o_totalprice").cast("int").alias("view_count"),
        (ok % 50).cast("int").alias("like_count"),
        (ok % 13 == 0).alias("is_featured"),
        (ok % 19 != 0).alias("allow_comments"),
        created.alias("created_at"),
        F.when(ok % 4 == 0, _plus(_ts(POSTS_EPOCH), ok % 30, ok % 24 + 12)).alias("updated_at"),
    )


def comments_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _read(spark, sf_dir, "events").select(
        e.alias("id"),
        F.concat_ws(" ", "event_type", "props").alias("content"),
        F.col("user_id").alias("author_id"),
        ((e * 7) % COMMENT_POST_MODULUS).alias("post_id"),
        F.when((e >= REPLY_OFFSET) & (e % 3 != 0), e - REPLY_OFFSET).alias("parent_id"),
        (e % 5 == 0).alias("is_edited"),
        F.floor("value").cast("int").alias("like_count"),
        F.col("ts").alias("created_at"),
        F.when(e % 5 == 0, F.col("ts")).alias("updated_at"),
    )


def likes_raw_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Like requests as logged: duplicates and orphans included."""
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("user_id"),
        F.col("l_orderkey").alias("comment_id"),
        F.col("l_shipdate").alias("created_at"),
    )


def comment_likes_view(likes_raw: DataFrame, users: DataFrame, comments: DataFrame) -> DataFrame:
    """Unique, FK-valid likes: first request per (user, comment) pair.

    The requests are counted (of Parquet files: from their footers), so that
    the joins are dealt over partitions that grow with them."""
    parts = task_parts(likes_raw.sparkSession, likes_raw.count())
    who = dealt(users.select(F.col("id").alias("user_id")), parts, "user_id")
    what = dealt(comments.select(F.col("id").alias("comment_id")), parts, "comment_id")
    return (
        likes_raw.join(who, "user_id", "left_semi")
        .join(what, "comment_id", "left_semi")
        .groupBy("user_id", "comment_id")
        .agg(F.min("created_at").alias("created_at"))
    )


_BUILT: dict[tuple[int, str], tuple[SparkSession, ContentTables]] = {}


def content_tables(spark: SparkSession, sf_dir: str) -> ContentTables:
    """The five content tables over ``sf_dir`` (lazy DataFrames).

    The plans are built once per session and folder and then reused: each
    view costs hundreds of JVM round trips to construct, while reusing a
    lazy DataFrame costs nothing and re-reads the files on every action.
    """
    key = (id(spark), sf_dir)
    hit = _BUILT.get(key)
    if hit is not None and hit[0] is spark and not spark.sparkContext._jsc.sc().isStopped():
        return hit[1]
    users = users_view(spark, sf_dir)
    comments = comments_view(spark, sf_dir)
    tables = ContentTables(
        users=users,
        categories=categories_view(spark, sf_dir),
        posts=posts_view(spark, sf_dir),
        comments=comments,
        comment_likes=comment_likes_view(likes_raw_view(spark, sf_dir), users, comments),
    )
    _BUILT[key] = (spark, tables)
    return tables


def like_log_view(
    spark: SparkSession, sf_dir: str, users: DataFrame | None = None, comments: DataFrame | None = None
) -> DataFrame:
    """Like/unlike events from the like log: every third line item of an
    order is an unlike.  With ``users``/``comments`` only FK-valid events
    are kept (requests on missing rows never reach the table)."""
    log = _read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("user_id"),
        F.col("l_orderkey").alias("comment_id"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_linenumber").cast("bigint").alias("event_id"),
        F.when(F.col("l_linenumber") % 3 == 0, "unlike").otherwise("like").alias("action"),
    )
    if users is not None:
        log = log.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    if comments is not None:
        log = log.join(comments.select(F.col("id").alias("comment_id")), "comment_id", "left_semi")
    return log
