"""Validation of change batches (V1-V5), as set-based jobs.

A validator takes a batch DataFrame and the current tables and returns the
batch with a ``reasons`` array (empty = valid); :func:`split` separates valid
rows from rejects.  Existence checks are joins against one-row-per-key
projections of the tables.  "Already taken" checks inside the batch replay
it: only a row that passes every other rule can claim a key, and an earlier
rejected row claims nothing.  They use grouped first occurrences (partial
aggregates) joined back by key, never a window over a possibly hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlens import schema as S
from contentlens.operators.components import connected_components
from contentlens.operators.hierarchy import reparent_conflicts
from contentlens.operators.skew import split_left_join
from contentlens.session import ensure_checkpoint_dir, stored


def _reason(cond: Column, label: str) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(label))


def _reasons(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _len_outside(col: str, lo: int | None, hi: int | None, required: bool = True) -> Column:
    n = F.char_length(F.col(col))
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (n < lo)
    if hi is not None:
        bad = bad | (n > hi)
    if required:
        bad = bad | F.col(col).isNull()
    return bad


def _exists(
    df: DataFrame, key_expr: Column, keys: DataFrame, key_col: str, flag: str, unique: bool = False
) -> DataFrame:
    """Left-join a key projection; adds boolean ``flag``.  ``unique`` marks
    a primary key, which needs no de-duplication (and no extra shuffle)."""
    right = keys.select(F.col(key_col).alias(f"__{flag}"))
    if not unique:
        right = right.distinct()
    right = right.withColumn(flag, F.lit(True))
    out = df.join(right, key_expr == F.col(f"__{flag}"), "left").drop(f"__{flag}")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


#: Rows of one conflict component that a task replays; of larger ones so many
#: at a time, in order.
REPLAY_ROWS = 1_000_000


def _replayed(rows: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Rows that a one-by-one replay of each ``group`` accepts, in one pass over
    partitions that are sorted by group and order.  A task holds the keys that
    the group it is in has taken."""

    def run(batches):
        import pyarrow as pa

        now, taken = None, [set() for _ in keys]
        for batch in batches:
            groups = batch.column(batch.schema.get_field_index(group)).to_pylist()
            cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            ok = []
            for g, *own in zip(groups, *cols):
                if g != now:
                    now, taken = g, [set() for _ in keys]
                free = not any(k in t for k, t in zip(own, taken))
                if free:
                    for k, t in zip(own, taken):
                        t.add(k)
                ok.append(free)
            yield batch.filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def _free_of(rows: DataFrame, won: DataFrame, keys: list[str]) -> DataFrame:
    """Rows none of whose keys a row of ``won`` has taken."""
    for k in keys:
        rows = rows.join(won.select(k), k, "left_anti")
    return rows


def _accepted(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows that a one-by-one replay in the order of ``at`` (unique) accepts:
    a row is refused when an accepted earlier row has one of its ``keys``.

    Of rows equal in all keys only the first can be accepted.  Twice, rows that
    come first under each of their keys are accepted and the other rows of those
    keys refused, which settles most of a batch.  What is left are chains of
    conflicts: rows are grouped into components of the graph of keys (in
    O(log n) rounds) and each component is replayed in one pass.  A component of
    more than REPLAY_ROWS rows is replayed so many rows at a time, and what each
    step accepts removes its conflicts everywhere.
    """
    cols = rows.columns
    left = stored(rows.groupBy(*keys).agg(F.min(at).alias(at)).select(*cols), "claims")
    taken = []
    for _ in range(2):
        marked = left
        for i, k in enumerate(keys):
            marked = marked.join(left.groupBy(k).agg(F.min(at).alias(f"__first{i}")), k)
        wins = F.lit(True)
        for i in range(len(keys)):
            wins = wins & (F.col(at) == F.col(f"__first{i}"))
        won = stored(marked.where(wins).select(*cols), "accepted")
        taken.append(won)
        left = stored(_free_of(left, won, keys).select(*cols), "claims")
        if left.isEmpty():
            break
    else:
        taken += _chains(left, keys, at)
    out = taken[0]
    for won in taken[1:]:
        out = out.unionByName(won)
    return out


def _chains(left: DataFrame, keys: list[str], at: str) -> list[DataFrame]:
    """The accepted rows among conflicts that hang together in chains."""
    cols, group = left.columns, "__group"
    # hashes may only join components that could be apart; the replay compares the keys themselves
    node = [F.xxhash64(F.lit(i), F.col(k)) for i, k in enumerate(keys)]
    ends = F.explode(F.array(*[F.struct(node[0].alias("a"), n.alias("b")) for n in node]))
    roots = connected_components(left.select(ends.alias("e")).select("e.*"), "a", "b")
    roots = roots.select(F.col("vertex").alias("__v"), F.col("root").alias(group))
    rows = stored(left.withColumn("__v", node[0]).join(roots, "__v").select(*cols, group), "conflicts")
    large = stored(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > REPLAY_ROWS).select(group), "large")
    small = rows.join(large, group, "left_anti").repartition(F.col(group)).sortWithinPartitions(group, at)
    taken = [stored(_replayed(small, keys, group).select(*cols), "accepted")]
    rest = stored(rows.join(large, group, "left_semi").select(*cols), "claims")
    while not rest.isEmpty():
        first = rest.orderBy(at).limit(REPLAY_ROWS).coalesce(1).sortWithinPartitions(at).withColumn(group, F.lit(0))
        won = stored(_replayed(first, keys, group).select(*cols), "accepted")
        taken.append(won)
        rest = stored(_free_of(rest, won, keys).select(*cols), "claims")
    return taken


def _taken_before(df: DataFrame, accepted: DataFrame, key: str, at: str, flag: str) -> DataFrame:
    """``flag`` = an accepted earlier row has this row's ``key``."""
    claim = accepted.select(F.col(key).alias(f"__{flag}_key"), F.col(at).alias(f"__{flag}_at"))
    out = df.join(claim, F.col(key) == F.col(f"__{flag}_key"), "left")
    return out.withColumn(flag, F.coalesce(F.col(f"__{flag}_at") < F.col(at), F.lit(False)))


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without ``reasons``, rejected rows with ``reasons``)."""
    ok = F.size("reasons") == 0
    return validated.where(ok).drop("reasons"), validated.where(~ok)


def validate_users(batch: DataFrame, users: DataFrame, order: str | tuple[str, ...] = "seq") -> DataFrame:
    """V1: batch(email, username[, full_name], seq).

    Rows are replayed in the order of ``seq`` (or of several columns); rows
    equal in it in an arbitrary but fixed order.  A row that breaks a field rule or meets a
    stored email or username is refused and claims nothing; of the others,
    each is accepted unless an accepted earlier row has its email or username.
    """
    b = batch if "full_name" in batch.columns else batch.withColumn("full_name", F.lit(None).cast("string"))
    b = _exists(b, F.col("email"), users, "email", "__email_stored")
    b = _exists(b, F.col("username"), users, "username", "__username_stored")
    ensure_checkpoint_dir(b.sparkSession)
    cols = [order] if isinstance(order, str) else list(order)
    at = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(cols)], F.monotonically_increasing_id().alias("r"))
    b = b.withColumn("__at", at).checkpoint()
    bad_email = ~F.coalesce(F.col("email").rlike(S.EMAIL_PATTERN), F.lit(False))
    bad_username = _len_outside("username", *S.USERNAME_LEN)
    bad_name = F.coalesce(_len_outside("full_name", None, S.FULL_NAME_MAX, required=False), F.lit(False))
    sound = ~(bad_email | bad_username | bad_name | F.col("__email_stored") | F.col("__username_stored"))
    accepted = _accepted(b.where(sound).select("email", "username", "__at"), ["email", "username"], "__at")
    b = _taken_before(b, accepted, "email", "__at", "__email_dup")
    b = _taken_before(b, accepted, "username", "__at", "__username_dup")
    reasons = _reasons(
        _reason(bad_email, "email_invalid"),
        _reason(bad_username, "username_length"),
        _reason(bad_name, "full_name_length"),
        _reason(F.col("__email_stored") | F.col("__email_dup"), "email_taken"),
        _reason(F.col("__username_stored") | F.col("__username_dup"), "username_taken"),
    )
    return b.withColumn("reasons", reasons).select(*batch.columns, "reasons")


def validate_categories(batch: DataFrame, categories: DataFrame, order: str = "seq") -> DataFrame:
    """V2: batch(id, name, slug[, description], parent_id, seq) of new or
    changed categories.  Slug must be unique among *other* categories, the
    parent must exist (in the table or the batch), and no change may put a
    category on a parent cycle.  Only rows that pass all other rules claim
    their slug, the first by (``seq``, id)."""
    b = batch if "description" in batch.columns else batch.withColumn("description", F.lit(None).cast("string"))
    owners = categories.groupBy("slug").agg(F.min("id").alias("__o_min"), F.max("id").alias("__o_max"))
    b = b.join(owners, "slug", "left").withColumn(
        "__slug_taken",
        F.coalesce((F.col("__o_min") != F.col("id")) | (F.col("__o_max") != F.col("id")), F.lit(False)),
    )
    known = categories.select("id").unionByName(batch.select("id"))
    b = _exists(b, F.col("parent_id"), known, "id", "__parent_found")
    cyc = reparent_conflicts(categories, batch.select("id", "parent_id"))
    b = _exists(b, F.col("id"), cyc, "id", "__cycle", unique=True)
    bad_name = _len_outside("name", *S.CATEGORY_NAME_LEN)
    bad_slug = _len_outside("slug", *S.CATEGORY_SLUG_LEN) | ~F.coalesce(F.col("slug").rlike(S.SLUG_PATTERN), F.lit(False))
    bad_text = F.coalesce(_len_outside("description", None, S.CATEGORY_DESCRIPTION_MAX, required=False), F.lit(False))
    no_parent = F.col("parent_id").isNotNull() & ~F.col("__parent_found")
    sound = ~(bad_name | bad_slug | bad_text | F.col("__slug_taken") | no_parent | F.col("__cycle"))
    claims = b.where(sound).groupBy("slug").agg(F.min(F.struct(order, "id")).alias("__claim"))
    b = b.join(claims, "slug", "left").withColumn(
        "__slug_dup",
        F.coalesce((F.col("__claim.id") != F.col("id")) & (F.struct(order, "id") > F.col("__claim")), F.lit(False)),
    )
    reasons = _reasons(
        _reason(bad_name, "name_length"),
        _reason(bad_slug, "slug_invalid"),
        _reason(bad_text, "description_length"),
        _reason(F.col("__slug_taken") | F.col("__slug_dup"), "slug_taken"),
        _reason(no_parent, "parent_not_found"),
        _reason(F.col("__cycle"), "parent_cycle"),
    )
    return b.withColumn("reasons", reasons).select(*batch.columns, "reasons")


def validate_posts(batch: DataFrame, users: DataFrame, categories: DataFrame) -> DataFrame:
    """V3: title, content, excerpt, status; author and category exist."""
    b = batch if "excerpt" in batch.columns else batch.withColumn("excerpt", F.lit(None).cast("string"))
    b = _exists(b, F.col("author_id"), users, "id", "__author_found", unique=True)
    b = _exists(b, F.col("category_id"), categories, "id", "__category_found", unique=True)
    reasons = _reasons(
        _reason(_len_outside("title", *S.POST_TITLE_LEN), "title_length"),
        _reason(_len_outside("content", 1, None), "content_empty"),
        _reason(_len_outside("excerpt", None, S.POST_EXCERPT_MAX, required=False), "excerpt_length"),
        _reason(~F.coalesce(F.col("status").isin(*S.POST_STATUSES), F.lit(False)), "status_invalid"),
        _reason(~F.col("__author_found"), "author_not_found"),
        _reason(F.col("category_id").isNotNull() & ~F.col("__category_found"), "category_not_found"),
    )
    return b.withColumn("reasons", reasons).select(*batch.columns, "reasons")


def validate_comments(batch: DataFrame, posts: DataFrame, comments: DataFrame, split_hot: bool = False) -> DataFrame:
    """V4: content 1..1000; post exists and allows comments; the parent
    exists and belongs to the same post.

    Both lookups join one row per key (post id, comment id) onto the batch;
    a batch concentrated on one hot post is split by AQE's skew handling
    without duplicating work, since the right side has one row per key; with
    ``split_hot`` hot posts and parents are counted first and kept out of the
    shuffle.  Root comments (no parent) go around the second join.
    """
    p = posts.select(F.col("id").alias("__pid"), F.col("allow_comments").alias("__allow"))
    c = comments.select(F.col("id").alias("__cid"), F.col("post_id").alias("__parent_post"))
    def looked_up(rows: DataFrame, table: DataFrame, key: str, table_key: str) -> DataFrame:
        if split_hot:
            return split_left_join(rows, table, key, table_key)
        return rows.join(table, F.col(key) == F.col(table_key), "left")

    b = looked_up(batch, p, "post_id", "__pid")
    replies = looked_up(b.where(F.col("parent_id").isNotNull()), c, "parent_id", "__cid")
    roots = b.where(F.col("parent_id").isNull())
    b = replies.unionByName(roots, allowMissingColumns=True)
    reasons = _reasons(
        _reason(_len_outside("content", *S.COMMENT_CONTENT_LEN), "content_length"),
        _reason(F.col("__pid").isNull(), "post_not_found"),
        _reason(F.col("__pid").isNotNull() & ~F.coalesce(F.col("__allow"), F.lit(True)), "comments_not_allowed"),
        _reason(F.col("parent_id").isNotNull() & F.col("__cid").isNull(), "parent_not_found"),
        _reason(F.col("__cid").isNotNull() & (F.col("__parent_post") != F.col("post_id")), "parent_other_post"),
    )
    return b.withColumn("reasons", reasons).select(*batch.columns, "reasons")


def validate_like_requests(requests: DataFrame, users: DataFrame, comments: DataFrame,
                           likes: DataFrame | None = None) -> DataFrame:
    """V5 over a log of like requests ``(user_id, comment_id, created_at)``
    replayed in time order against the current ``likes``.

    Identical requests are first folded into one row with a ``requests``
    count (a partial aggregate), so a hot pair never lands whole in one
    task.  Output rows: user_id, comment_id, created_at, reasons, requests.
    A request fails with comment_not_found / user_not_found, else with
    already_liked when the pair is stored already or an earlier request of
    the pair succeeded.
    """
    g = requests.groupBy("user_id", "comment_id", "created_at").agg(F.count(F.lit(1)).alias("n"))
    first = g.groupBy("user_id", "comment_id").agg(F.min("created_at").alias("__first"))
    g = g.join(first, ["user_id", "comment_id"])
    g = _exists(g, F.col("comment_id"), comments, "id", "__comment_found", unique=True)
    g = _exists(g, F.col("user_id"), users, "id", "__user_found", unique=True)
    if likes is not None:
        stored = likes.select("user_id", "comment_id").distinct().withColumn("__stored", F.lit(True))
        g = g.join(stored, ["user_id", "comment_id"], "left")
    else:
        g = g.withColumn("__stored", F.lit(None).cast("boolean"))
    stored = F.coalesce(F.col("__stored"), F.lit(False))
    fk_ok = F.col("__comment_found") & F.col("__user_found")
    fk = [
        _reason(~F.col("__comment_found"), "comment_not_found"),
        _reason(~F.col("__user_found"), "user_not_found"),
    ]
    is_first = F.col("created_at") == F.col("__first")
    lead = _reasons(*fk, _reason(fk_ok & stored, "already_liked"))
    rest = _reasons(*fk, _reason(fk_ok, "already_liked"))
    # The first request of a pair may succeed; every later one (including
    # identical copies of the first) meets an existing like.
    parts = F.when(
        is_first,
        F.array(
            F.struct(lead.alias("reasons"), F.lit(1).cast("bigint").alias("requests")),
            F.struct(rest.alias("reasons"), (F.col("n") - 1).alias("requests")),
        ),
    ).otherwise(F.array(F.struct(rest.alias("reasons"), F.col("n").alias("requests"))))
    return (
        g.select("user_id", "comment_id", "created_at", F.inline(parts))
        .where(F.col("requests") > 0)
    )


def split_like_events(events: DataFrame, users: DataFrame, comments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Like/unlike events whose comment and user exist (to replay), and the
    others with ``reasons`` (rejected without touching any state)."""
    e = _exists(events, F.col("comment_id"), comments, "id", "__comment_found", unique=True)
    e = _exists(e, F.col("user_id"), users, "id", "__user_found", unique=True)
    reasons = _reasons(
        _reason(~F.col("__comment_found"), "comment_not_found"),
        _reason(~F.col("__user_found"), "user_not_found"),
        _reason(~F.coalesce(F.col("action").isin("like", "unlike"), F.lit(False)), "action_invalid"),
    )
    checked = e.withColumn("reasons", reasons).select(*events.columns, "reasons")
    return split(checked)
