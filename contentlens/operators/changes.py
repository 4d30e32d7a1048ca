"""Applying change batches (W1-W9): each returns the next table version.

All appliers are joins on the primary key between the table and a batch
that has at most one row per key, so they cost one shuffle of each side
(or none for the table when the batch is small enough for AQE to
broadcast it).  Nothing is written here; :func:`save_tables` writes the
resulting snapshot to a new folder.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentlens.operators.hierarchy import subtree
from contentlens.operators.ordered import ranged, reduce_in_place
from contentlens.session import stored
from contentlens.sources.spine import as_of_literal
from contentlens.sources.tables import ContentTables

# Fixed column defaults of the reference model (applied on insert).
DEFAULTS = {
    "users": {"role": "user", "is_active": True, "is_verified": False},
    "categories": {"order": 0},
    "posts": {
        "status": "draft",
        "view_count": 0,
        "like_count": 0,
        "is_featured": False,
        "allow_comments": True,
    },
    "comments": {"is_edited": False, "like_count": 0},
    "comment_likes": {},
}


def _cast_like(batch: DataFrame, table: DataFrame) -> DataFrame:
    """Batch columns in the table's order and types; missing ones NULL."""
    have = set(batch.columns)
    return batch.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in table.schema.fields
        ]
    )


def insert_rows(table: DataFrame, rows: DataFrame, table_name: str, as_of) -> DataFrame:
    """Append rows with the model defaults; a given id is kept, a
    missing string id gets a random UUID; created_at defaults to ``as_of``.
    A missing id of another type fails the job: it can't be made up.

    Generated UUIDs are drawn when the plan runs: write the result (for
    example with :func:`save_tables`) or ``checkpoint()`` it before using the
    new ids in a second job, so every job sees the same ids."""
    r = _cast_like(rows, table)
    fixes = {}
    for col, default in DEFAULTS.get(table_name, {}).items():
        if col in r.columns:
            fixes[col] = F.coalesce(F.col(f"`{col}`"), F.lit(default).cast(r.schema[col].dataType))
    if "tags" in r.columns:
        fixes["tags"] = F.coalesce("tags", F.array().cast("array<string>"))
    if "id" in r.columns and r.schema["id"].dataType.typeName() == "string":
        fixes["id"] = F.coalesce("id", F.expr("uuid()"))
    elif "id" in r.columns:
        fixes["id"] = F.coalesce("id", F.raise_error(F.lit("insert_rows: a row has no id")).cast(r.schema["id"].dataType))
    if "created_at" in r.columns:
        fixes["created_at"] = F.coalesce("created_at", as_of_literal(as_of))
    if "updated_at" in r.columns:
        fixes["updated_at"] = F.lit(None).cast(r.schema["updated_at"].dataType)
    r = r.withColumns(fixes) if fixes else r
    return table.unionByName(r)


def _update(
    table: DataFrame, changes: DataFrame, as_of, mode: str, keep_if_null: tuple[str, ...] = (), order: str | None = None
) -> DataFrame:
    """Changes are first folded to one per id: with ``order`` to the last one
    (a column that keeps its value on NULL takes the last given value);
    without it two changes for one id fail the job."""
    cols = [c for c in changes.columns if c not in ("id", order) and c in table.columns]
    whole = F.struct(F.lit(True).alias("hit"), *[F.col(f"`{c}`") for c in cols])
    if order is None:
        twice = F.raise_error(F.lit("update: two changes for one id; name the order column"))
        only = F.when(F.count(F.lit(1)) > 1, twice).otherwise(F.first(whole))
        folded = changes.groupBy("id").agg(only.alias("__c"))
        value = {c: F.col(f"__c.`{c}`") for c in cols}
    else:
        kept = [c for c in cols if mode == "merge" or c in keep_if_null]
        last = [F.max_by(f"`{c}`", F.when(F.col(f"`{c}`").isNotNull(), F.col(order))).alias(f"__k_{c}") for c in kept]
        folded = changes.groupBy("id").agg(F.max_by(whole, F.col(order)).alias("__c"), *last)
        value = {c: F.col(f"`__k_{c}`") if c in kept else F.col(f"__c.`{c}`") for c in cols}
    ch = folded.select("id", F.col("__c.hit").alias("__hit"), *[v.alias(f"__new_{c}") for c, v in value.items()])
    j = table.join(ch, "id", "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    out = []
    for c in table.columns:
        old = F.col(f"`{c}`")
        if c in cols:
            new = F.col(f"`__new_{c}`")
            if mode == "merge" or c in keep_if_null:
                new = F.coalesce(new, old)
            out.append(F.when(hit, new).otherwise(old).alias(c))
        elif c == "updated_at":
            out.append(F.when(hit, as_of_literal(as_of)).otherwise(old).alias(c))
        else:
            out.append(old)
    return j.select(*out)


def update_replace(
    table: DataFrame, changes: DataFrame, as_of, keep_if_null: tuple[str, ...] = ("status",), order: str | None = None
) -> DataFrame:
    """Changed rows take every given column (``status`` only when
    given, as the post update rule); ``updated_at = as_of``.  Of several
    changes for one id the last by ``order`` holds."""
    return _update(table, changes, as_of, "replace", keep_if_null, order)


def update_merge(table: DataFrame, changes: DataFrame, as_of, order: str | None = None) -> DataFrame:
    """Only non-NULL change fields overwrite (category rule; a parent
    can therefore not be cleared this way)."""
    return _update(table, changes, as_of, "merge", (), order)


def edit_comments(comments: DataFrame, edits: DataFrame, as_of, order: str | None = None) -> DataFrame:
    """Content replaced and ``is_edited`` set."""
    ch = edits.select("id", "content", *([order] if order else [])).withColumn("is_edited", F.lit(True))
    return _update(comments, ch, as_of, "replace", (), order)


def set_status(posts: DataFrame, ids: DataFrame, status: str, as_of) -> DataFrame:
    """Publish / archive as a one-column update."""
    return update_replace(posts, ids.select("id").distinct().withColumn("status", F.lit(status)), as_of)


def _ordered_segments(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The stretches in which a log is walked: :func:`ranged` rows with the
    number of their partition, for a look at how a hot key is dealt out."""
    return ranged(events, key, order).withColumn("__seg", F.spark_partition_id())


def _like_walk(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Like/unlike events walked in order, one row per pair: the first event's
    action and time (whether it changes anything depends on the stored state),
    the last action, the changes after the first event, the time of the last
    change to liked among them, the number of events.

    The log goes through one range exchange and is reduced where it lies
    (:func:`reduce_in_place`); summaries of the few pairs at the borders of
    partitions are chained.
    """
    # other actions are refused requests and touch nothing
    known = events.where(F.col("action").isin("like", "unlike"))
    rows = known.select(*key, (F.col("action") == "like").alias("a"), *order)

    def summarise(batch, starts):
        import numpy as np
        import pyarrow as pa

        a = batch.column(batch.schema.get_field_index("a")).to_numpy(zero_copy_only=False)
        ts = batch.column(batch.schema.get_field_index("ts"))
        n = len(a)
        change = np.zeros(n, bool)
        change[1:] = a[1:] != a[:-1]
        change[starts] = False
        liked_at = np.maximum.reduceat(np.where(change & a, np.arange(n), -1), starts)
        ends = np.append(starts[1:], n) - 1
        return {
            "first_a": a[starts], "first_ts": ts.take(pa.array(starts)), "last_a": a[ends],
            "flips": np.add.reduceat(change.astype(np.int64), starts),
            "like_ts": ts.take(pa.array(liked_at, mask=liked_at < 0)), "n": (ends - starts + 1).astype(np.int64),
        }

    def combine(left, right):
        turn = right["first_a"] != left["last_a"]
        since = right["like_ts"] if right["like_ts"] is not None else right["first_ts"] if turn and right["first_a"] else left["like_ts"]
        return {
            **left, "last_a": right["last_a"], "flips": left["flips"] + right["flips"] + int(turn),
            "like_ts": since, "n": left["n"] + right["n"],
        }

    kind = rows.schema["ts"].dataType.simpleString()
    done, edges = reduce_in_place(
        ranged(rows, key, order), key, summarise, combine,
        f"first_a boolean, first_ts {kind}, last_a boolean, flips long, like_ts {kind}, n long", "like-walk",
    )
    w = Window.partitionBy(*key).orderBy("__seg")  # at most two rows a partition in all
    turn = F.coalesce(F.col("first_a") != F.lag("last_a").over(w), F.lit(False))
    edges = edges.withColumn("__turn", turn).withColumn(
        "__since", F.coalesce("like_ts", F.when(F.col("__turn") & F.col("first_a"), F.col("first_ts")))
    )
    chained = edges.groupBy(*key).agg(
        F.min_by("first_a", "__seg").alias("first_a"),
        F.min_by("first_ts", "__seg").alias("first_ts"),
        F.max_by("last_a", "__seg").alias("last_a"),
        (F.sum("flips") + F.count_if("__turn")).alias("flips"),
        F.max_by("__since", F.when(F.col("__since").isNotNull(), F.col("__seg"))).alias("like_ts"),
        F.sum("n").alias("n"),
    )
    return done.unionByName(chained)


def _turned(before) -> dict:
    """Outcome of a walked pair whose state was ``before`` the first event."""
    turn = F.col("first_a") != before
    return {
        "liked": F.col("last_a"),
        "accepted": F.col("flips") + turn.cast("bigint"),
        "rejected": F.col("n") - F.col("flips") - turn.cast("bigint"),
        "liked_since": F.coalesce("like_ts", F.when(turn & F.col("first_a"), F.col("first_ts"))),
    }


def like_event_outcomes(likes: DataFrame, events: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Replay like/unlike ``events(user_id, comment_id, action, ts,
    event_id)`` against the stored ``likes``.

    A like is accepted only when the pair is not liked, an unlike only when
    it is; either way the state afterwards equals the event's action.  So an
    event is accepted iff its action differs from the previous event's
    action (or from the stored state for the first event).  Per pair:
    user_id, comment_id, liked (final state), accepted, rejected, liked_since
    (time of the last accepted like).

    The log is exchanged once, by ranges of (pair, order), so no pair's whole
    history is ever gathered in one task; after that a pair is one row.
    """
    key = ["user_id", "comment_id"]
    walked = _like_walk(events, key, list(order))
    held = likes.select(*key).distinct().withColumn("__stored", F.lit(True))
    out = _turned(F.coalesce("__stored", F.lit(False)))
    return walked.join(held, key, "left").select(*key, *[c.alias(k) for k, c in out.items()])


def apply_like_events(likes: DataFrame, events: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The like table after the events.

    Pairs without events are kept.  A pair that ends liked keeps its stored
    row unless a like was accepted (the row was then (re)inserted by the last
    accepted like, whose ``ts`` becomes ``created_at``).  Table and walked pairs
    meet in one join.
    """
    key = ["user_id", "comment_id"]
    walked = _like_walk(events, key, list(order))
    kind = likes.schema["created_at"].dataType
    both = likes.withColumn("__stored", F.lit(True)).join(walked, key, "full")
    since = _turned(F.coalesce("__stored", F.lit(False)))["liked_since"]
    value = {"created_at": F.when(F.col("n").isNull(), F.col("created_at")).otherwise(F.coalesce(since.cast(kind), "created_at"))}
    return both.where("n IS NULL OR last_a").select(*[value[c].alias(c) if c in value else F.col(f"`{c}`") for c in likes.columns])


def likes_after_outcomes(likes: DataFrame, out: DataFrame) -> DataFrame:
    """The like table after a replay whose outcomes are known (and stored)."""
    key = ["user_id", "comment_id"]
    untouched = likes.join(out.select(*key), key, "left_anti")
    added = (
        out.where("liked")
        .select(*key, "liked_since")
        .join(likes.select(*key, F.col("created_at").alias("__stored_at")), key, "left")
        .select(
            *key,
            F.coalesce("liked_since", "__stored_at").cast(likes.schema["created_at"].dataType).alias("created_at"),
        )
    )
    return untouched.unionByName(added)


def counter_after_deltas(
    table: DataFrame, deltas: DataFrame, column: str = "like_count", order: tuple[str, ...] = ("seq",)
) -> DataFrame:
    """Apply unit deltas ``(id, seq, delta)`` to ``column`` in seq order
    with a floor at zero (a decrement at 0 is ignored); another delta fails
    the job.

    The end value of the clamped walk is ``c0 + S_n - min(0, min_k(c0 +
    S_k))`` (S_k = prefix sums).  The log is exchanged once, by ranges of (id,
    order); sums and least prefix sums are taken where the deltas lie, and the
    ids at the borders of partitions are chained.  Returns id, old, new.
    """
    given = F.col("delta").cast("bigint")
    unit = F.when(F.abs(given) == 1, given).otherwise(
        F.raise_error(F.lit("counter_after_deltas: a delta is not 1 or -1")).cast("bigint")
    )
    rows = deltas.select("id", *order, unit.alias("delta"))

    def summarise(batch, starts):
        import numpy as np

        delta = batch.column(batch.schema.get_field_index("delta")).to_numpy(zero_copy_only=False).astype(np.int64)
        sums = np.concatenate(([0], np.cumsum(delta)))
        return {"s": np.add.reduceat(delta, starts), "m": np.minimum.reduceat(sums[1:], starts) - sums[starts]}

    def combine(left, right):
        return {**left, "s": left["s"] + right["s"], "m": min(left["m"], left["s"] + right["m"])}

    done, edges = reduce_in_place(ranged(rows, ["id"], list(order)), ["id"], summarise, combine, "s long, m long", "counter-walk")
    w = Window.partitionBy("id").orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("m", F.coalesce(F.sum("s").over(w), F.lit(0).cast("bigint")) + F.col("m"))
    chained = edges.groupBy("id").agg(F.sum("s").alias("s"), F.min("m").alias("m"))
    per_id = done.unionByName(chained).select("id", F.col("s").alias("total"), F.col("m").alias("low"))
    base = table.select("id", F.col(column).cast("bigint").alias("old"))
    j = base.join(per_id, "id", "left")
    low = F.least(F.lit(0).cast("bigint"), F.col("old") + F.coalesce("low", F.lit(0).cast("bigint")))
    new = F.col("old") + F.coalesce("total", F.lit(0).cast("bigint")) - low
    return j.select("id", "old", F.when(F.col("total").isNull(), F.col("old")).otherwise(new).alias("new"))


def apply_counter_deltas(
    table: DataFrame, deltas: DataFrame, column: str = "like_count", order: tuple[str, ...] = ("seq",)
) -> DataFrame:
    """The table with ``column`` replaced by the replayed value."""
    res = counter_after_deltas(table, deltas, column, order).select("id", F.col("new").alias("__new"))
    dtype = table.schema[column].dataType
    return table.join(res, "id", "left").select(
        *[F.col("__new").cast(dtype).alias(c) if c == column else F.col(f"`{c}`") for c in table.columns]
    )


def delete_likes(likes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove (user_id, comment_id) pairs; also report per requested
    pair whether a row went (``removed``)."""
    key = ["user_id", "comment_id"]
    present = likes.select(*key).distinct().withColumn("removed", F.lit(True))
    report = pairs.select(*key).join(present, key, "left").withColumn(
        "removed", F.coalesce("removed", F.lit(False))
    )
    return likes.join(pairs.select(*key), key, "left_anti"), report


def category_delete_rejects(categories: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested category ids that still have children (refused)."""
    parents = categories.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id"))
    return ids.select("id").join(parents, "id", "left_semi").withColumn("reason", F.lit("has_children"))


def _flagged(df: DataFrame, refs: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of ``df`` whose column matches any of the id sets: one scan of
    ``df`` and one key-unique left join per set (an OR of semi joins)."""
    hit = F.lit(False)
    for i, (col, ids) in enumerate(refs):
        flag = f"__hit{i}"
        df = df.join(ids.select(F.col("id").alias(col), F.lit(True).alias(flag)).distinct(), col, "left")
        hit = hit | F.coalesce(F.col(flag), F.lit(False))
    return df.where(hit).drop(*[f"__hit{i}" for i in range(len(refs))])


class _Cascade:
    """The id sets that a delete reaches.  Each is planned when it is first asked
    for; the set of comments, which needs rounds, is then written once."""

    def __init__(self, t: ContentTables, table: str, ids: DataFrame):
        if table not in ("users", "categories", "posts", "comments"):
            raise ValueError(f"cascade delete from {table!r} is not defined")
        self.t, self.table = t, table
        self.ids = ids.select(F.col(ids.columns[0]).alias("id")).distinct()

    def _own(self, table: str) -> DataFrame:
        rows = self.t.as_dict()[table].select("id")
        return rows.join(self.ids, "id", "left_semi") if table == self.table else rows.limit(0)

    @cached_property
    def users(self) -> DataFrame:
        return self._own("users")

    @cached_property
    def categories(self) -> DataFrame:
        return self._own("categories")

    @cached_property
    def posts(self) -> DataFrame:
        if self.table != "users":
            return self._own("posts")
        return self.t.posts.join(self.users.select(F.col("id").alias("author_id")), "author_id", "left_semi").select("id")

    @cached_property
    def comments(self) -> DataFrame:
        c = self.t.comments
        if self.table == "users":
            # one pass over comments: by a deleted author or on a deleted post
            flagged = _flagged(c.select("id", "author_id", "post_id"), [("author_id", self.users), ("post_id", self.posts)])
            seeds = flagged.select("id")
        elif self.table == "posts":
            # a thread stays on its post: the post's comments are all there is
            return c.join(self.posts.select(F.col("id").alias("post_id")), "post_id", "left_semi").select("id")
        else:
            seeds = self._own("comments")
            if self.table == "categories":
                return seeds
        # only the threads of the seeds' posts are walked
        return stored(subtree(c, stored(seeds, "seeds"), within="post_id"), "deleted-comments")

    @cached_property
    def likes(self) -> DataFrame:
        keys = self.t.comment_likes.select("user_id", "comment_id")
        return _flagged(keys, [("user_id", self.users), ("comment_id", self.comments)])

    def after(self, table: str) -> DataFrame:
        """The table after the delete."""
        rows = self.t.as_dict()[table]
        if table == self.table == "categories" or table == "posts" and self.table == "categories":
            ref = "parent_id" if table == "categories" else "category_id"
            if table == "categories":
                rows = rows.join(self.categories, "id", "left_anti")
            gone = self.categories.select(F.col("id").alias("__gone"), F.lit(True).alias("__g"))
            rows = rows.join(gone, F.col(ref) == F.col("__gone"), "left")
            return rows.withColumn(ref, F.when(F.col("__g").isNull(), F.col(ref))).drop("__gone", "__g")
        if table == "comment_likes":
            if self.table == "categories":
                return rows
            if self.table == "users":
                rows = rows.join(self.users.select(F.col("id").alias("user_id")), "user_id", "left_anti")
            out = rows.join(self.comments.select(F.col("id").alias("comment_id")), "comment_id", "left_anti")
            return out.select(*self.t.comment_likes.columns)
        reached = {"users": ("users",), "posts": ("users", "posts"), "comments": ("users", "posts", "comments")}
        if self.table not in reached.get(table, ()):
            return rows
        return rows.join(getattr(self, table), "id", "left_anti")


class _TablesAfter(ContentTables):
    """Tables after a delete; one is planned when it is first read."""

    def __init__(self, cascade: _Cascade):
        object.__setattr__(self, "_cascade", cascade)

    def __getattribute__(self, name: str):
        if name not in ContentTables.__dataclass_fields__:
            return super().__getattribute__(name)
        made = self.__dict__.get(name)
        if made is None:
            made = self.__dict__[name] = self._cascade.after(name)
        return made

    def with_(self, **changes: DataFrame) -> ContentTables:
        return ContentTables(**{**self.as_dict(), **changes})


def tables_after_delete(tables: ContentTables, table: str, ids: DataFrame) -> ContentTables:
    """The tables after deleting rows by id with the model's referential
    actions.

    user -> its posts, comments and likes; post -> its comments; comment ->
    its reply subtree (H5) and likes; category -> children's parent_id and
    posts' category_id set to NULL.  A next table reads only the id sets that it
    depends on: the posts after a user's delete never walk a thread.
    """
    return _TablesAfter(_Cascade(tables, table, ids))


def _removed(cascade: _Cascade) -> DataFrame:
    spark = cascade.t.users.sparkSession
    counts = spark.createDataFrame([(n, 0) for n in cascade.t.as_dict()], "table_name string, removed bigint")
    reached = {"users": ["users", "posts", "comments", "likes"], "posts": ["posts", "comments", "likes"], "comments": ["comments", "likes"]}
    for name in reached.get(cascade.table, [cascade.table]):
        label = F.lit("comment_likes" if name == "likes" else name).alias("table_name")
        counts = counts.unionByName(getattr(cascade, name).agg(F.count(F.lit(1)).alias("removed")).select(label, "removed"))
    return counts.groupBy("table_name").agg(F.sum("removed").alias("removed"))


def delete_counts(tables: ContentTables, table: str, ids: DataFrame) -> DataFrame:
    """Rows ``(table_name, removed)`` that :func:`tables_after_delete` removes."""
    return _removed(_Cascade(tables, table, ids))


def cascade_delete(tables: ContentTables, table: str, ids: DataFrame) -> tuple[ContentTables, DataFrame]:
    """:func:`tables_after_delete` and :func:`delete_counts` over the same id sets."""
    cascade = _Cascade(tables, table, ids)
    return _TablesAfter(cascade), _removed(cascade)


__all__ = [
    "DEFAULTS",
    "apply_counter_deltas",
    "apply_like_events",
    "cascade_delete",
    "category_delete_rejects",
    "counter_after_deltas",
    "delete_counts",
    "delete_likes",
    "edit_comments",
    "insert_rows",
    "like_event_outcomes",
    "likes_after_outcomes",
    "set_status",
    "tables_after_delete",
    "update_merge",
    "update_replace",
]
