"""Like/unlike requests as a stream (W3 + W4 on micro-batches).

Each micro-batch of events is replayed against the like table of the
previous batch with :func:`~contentlens.operators.changes.like_event_outcomes`
(same acceptance rule as the request handlers: a repeated like or an unlike
without a like is rejected).  Per batch the job writes, under ``state_dir``:

* ``likes/batch=<id>``     the like table after the batch (a new folder),
* ``outcomes/batch=<id>``  per (user, comment): final state, accepted, rejected,
* ``like_counts/batch=<id>`` per comment: like count change from the batch,
* ``rejected/batch=<id>``  events on missing comments/users (when the current
  ``users``/``comments`` snapshot folders are given), with reasons.

Writes are keyed by the batch id, so a batch replayed after a failure
overwrites only its own folders and the result is exactly-once.  The
streaming checkpoint (``checkpoint_dir``) must sit in the shared file system.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from contentlens.operators.changes import likes_after_outcomes, like_event_outcomes
from contentlens.operators.quality import split_like_events

LIKE_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("comment_id", T.LongType()),
        T.StructField("action", T.StringType()),
    ]
)
LIKES_SCHEMA = "user_id bigint, comment_id bigint, created_at timestamp_ntz"


def like_event_source(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame over Parquet event files arriving in ``path``."""
    reader = spark.readStream.schema(LIKE_EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def _snapshot(spark: SparkSession, state_dir: str, batch_id: int, initial_likes: str | None) -> DataFrame:
    if batch_id > 0:
        return spark.read.schema(LIKES_SCHEMA).parquet(f"{state_dir}/likes/batch={batch_id - 1}")
    if initial_likes:
        return spark.read.schema(LIKES_SCHEMA).parquet(initial_likes)
    return spark.createDataFrame([], LIKES_SCHEMA)


def process_batch(
    events: DataFrame,
    batch_id: int,
    state_dir: str,
    initial_likes: str | None = None,
    users_path: str | None = None,
    comments_path: str | None = None,
) -> None:
    """One micro-batch: validate, replay, then write the batch's outputs."""
    spark = events.sparkSession
    likes = _snapshot(spark, state_dir, batch_id, initial_likes)
    if users_path and comments_path:
        events, rejected = split_like_events(
            events, spark.read.parquet(users_path), spark.read.parquet(comments_path)
        )
        rejected.write.mode("overwrite").parquet(f"{state_dir}/rejected/batch={batch_id}")
    like_event_outcomes(likes, events).write.mode("overwrite").parquet(f"{state_dir}/outcomes/batch={batch_id}")
    outcomes = spark.read.parquet(f"{state_dir}/outcomes/batch={batch_id}")  # the events are replayed once
    before = likes.select("user_id", "comment_id", F.lit(True).alias("was"))
    # Like-count change per comment: pairs that flipped state in this batch.
    change = (
        outcomes.join(before, ["user_id", "comment_id"], "left")
        .select(
            "comment_id",
            (F.col("liked").cast("int") - F.coalesce(F.col("was"), F.lit(False)).cast("int")).alias("d"),
        )
        .groupBy("comment_id")
        .agg(F.sum("d").cast("bigint").alias("like_count_change"))
        .where(F.col("like_count_change") != 0)
    )
    change.write.mode("overwrite").parquet(f"{state_dir}/like_counts/batch={batch_id}")
    likes_after_outcomes(likes, outcomes).write.mode("overwrite").parquet(f"{state_dir}/likes/batch={batch_id}")


def start_like_stream(
    events: DataFrame,
    state_dir: str,
    checkpoint_dir: str,
    initial_likes: str | None = None,
    available_now: bool = False,
    processing_time: str | None = None,
    users_path: str | None = None,
    comments_path: str | None = None,
) -> StreamingQuery:
    """Start the stream; ``events`` is a streaming DataFrame of
    :data:`LIKE_EVENT_SCHEMA` rows (for example :func:`like_event_source`)."""
    writer = events.writeStream.option("checkpointLocation", checkpoint_dir).foreachBatch(
        lambda df, batch_id: process_batch(df, batch_id, state_dir, initial_likes, users_path, comments_path)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
