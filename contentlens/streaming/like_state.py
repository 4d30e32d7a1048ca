"""Like/unlike requests as keyed state (W3 + W4 in Structured Streaming).

Each (user, comment) pair is a key of a ``transformWithState`` operator whose
state lives in the RocksDB state store, so a micro-batch reads and writes the
pairs of its own events only, however large the like table is.  Events are
applied in event time: they wait in the pair's state until the watermark has
passed them and are then replayed in the order of (ts, event_id), so an event
that arrives late, but within ``delay``, takes its right place.  The result is
that of the batch replay (:func:`~contentlens.operators.changes.apply_like_events`).

Each batch appends the pairs that it settled to ``<out_dir>/batch=<id>``: the
new state and the accepted and rejected events.  The batch id names the folder,
so a batch that runs again after a failure replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ["user_id", "comment_id"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "user_id bigint, comment_id bigint, liked boolean, liked_since timestamp, accepted bigint, rejected bigint, settled_at timestamp"


def like_walker():
    """The stateful processor.  It is made here, so that workers get it whole."""
    import datetime as dt

    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    def millis(t: dt.datetime) -> int:
        return int(t.timestamp() * 1000)

    class LikeWalker(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("state", "liked boolean, liked_since timestamp")
            self.waiting = handle.getListState("waiting", "ts timestamp, event_id bigint, a boolean")
            self.timer = handle.getValueState("timer", "at bigint")

        def _wake(self, at: int) -> None:
            """One timer a key: at the earliest event that waits."""
            if self.timer.exists():
                now = self.timer.get()[0]
                if now <= at:
                    return
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.timer.update((at,))

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self.state.update((True, initialState.created_at))

        def handleInputRows(self, key, rows, timerValues):
            first = None
            for r in rows:
                self.waiting.appendValue((r.ts, r.event_id, r.a))
                first = r.ts if first is None or r.ts < first else first
            if first is not None:
                # an event exactly at the watermark may still come: wait until it has passed
                self._wake(millis(first) + 1)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.timer.clear()
            passed = timerValues.getCurrentWatermarkInMs()
            events = sorted((ts, number, a) for ts, number, a in self.waiting.get())
            ready = [e for e in events if millis(e[0]) < passed]
            rest = events[len(ready) :]
            liked, since = self.state.get() if self.state.exists() else (False, None)
            accepted = 0
            for ts, _, a in ready:
                if a != liked:
                    liked, accepted = a, accepted + 1
                    since = ts if a else since
            if rest:
                self.waiting.put(rest)
                self._wake(millis(rest[0][0]) + 1)
            else:
                self.waiting.clear()
            if not ready:
                return iter([])
            if liked:
                self.state.update((liked, since))
            else:
                self.state.clear()  # a pair that is not liked needs no state
            row = Row(
                user_id=key[0], comment_id=key[1], liked=liked, liked_since=since if liked else None,
                accepted=accepted, rejected=len(ready) - accepted, settled_at=ready[-1][0],
            )
            return iter([row])

        def close(self) -> None:
            pass

    return LikeWalker()


def like_changes(events: DataFrame, delay: str = "10 minutes", likes: DataFrame | None = None) -> DataFrame:
    """A streaming DataFrame of settled pairs (:data:`CHANGES`).

    ``events``: streaming rows of (event_id, ts, user_id, comment_id, action);
    ``likes``: a stored like table that the first batch starts from.  Events
    more than ``delay`` older than the newest one seen may be dropped.  Other
    actions than like and unlike are ignored.
    """
    spark = events.sparkSession
    # an operator of keyed state needs this store
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.where(F.col("action").isin("like", "unlike")).select(
        *KEY, "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("action") == "like").alias("a")
    )
    first = likes.select(*KEY, F.col("created_at").cast("timestamp").alias("created_at")).groupBy(*KEY) if likes is not None else None
    return rows.withWatermark("ts", delay).groupBy(*KEY).transformWithState(
        statefulProcessor=like_walker(), outputStructType=CHANGES, outputMode="Update", timeMode="EventTime", initialState=first
    )


def start_like_state(
    events: DataFrame,
    out_dir: str,
    checkpoint_dir: str,
    delay: str = "10 minutes",
    likes: DataFrame | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Start the stream; both folders lie in the shared file system."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    writer = like_changes(events, delay, likes).writeStream.outputMode("update")
    writer = writer.option("checkpointLocation", checkpoint_dir).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def settled_likes(spark: SparkSession, out_dir: str, likes: DataFrame) -> DataFrame:
    """The like table (user_id, comment_id, created_at) after all settled batches,
    from the one that the stream started with."""
    changes = spark.read.schema(f"{CHANGES}, batch bigint").option("basePath", out_dir).parquet(out_dir)
    last = changes.groupBy(*KEY).agg(F.max_by(F.struct("liked", "liked_since"), "batch").alias("s"))
    kind = likes.schema["created_at"].dataType
    now = last.where("s.liked").select(*KEY, F.col("s.liked_since").cast(kind).alias("created_at"))
    return likes.select(*KEY, "created_at").join(last, KEY, "left_anti").unionByName(now)


def settled_counts(spark: SparkSession, out_dir: str) -> DataFrame:
    """W4 from the same batches: comment_id, accepted, rejected, like_count_change."""
    changes = spark.read.schema(f"{CHANGES}, batch bigint").option("basePath", out_dir).parquet(out_dir)
    # each accepted event flips a pair, so the first state follows from the last and the parity
    per_pair = changes.groupBy(*KEY).agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.max_by("liked", "batch").cast("int").alias("now")
    )
    change = F.when(F.col("accepted") % 2 == 1, 2 * F.col("now") - 1).otherwise(0)
    return per_pair.groupBy("comment_id").agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.sum(change).cast("bigint").alias("like_count_change")
    )
