"""Hierarchies over parent pointers (H1-H5): categories and comment threads.

Every walk doubles: a lift table maps a node to its ancestor 1, 2, 4, ...
steps up, and one round doubles the distance covered, so a chain of depth D
needs about log2(D) rounds of one job each.  A round is linear in the nodes
(or in the pairs asked for) and is written once by a reliable checkpoint in
the session's shared folder, which also cuts the lineage.  Loops end when
nothing is left to move, on cycles too; no row is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.session import ensure_checkpoint_dir


def _cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _parents(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(v, a): each node and its parent; roots are absent."""
    return nodes.where(F.col(parent_col).isNotNull()).select(F.col(id_col).alias("v"), F.col(parent_col).alias("a")).distinct()


def _compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """(v, a) o (v, a): v -> second(first(v))."""
    s2 = second.select(F.col("v").alias("__v"), F.col("a").alias("__a"))
    return first.join(s2, F.col("a") == F.col("__v")).select("v", F.col("__a").alias("a"))


def closure(
    nodes: DataFrame,
    seeds: DataFrame,
    direction: str = "up",
    id_col: str = "id",
    parent_col: str = "parent_id",
) -> DataFrame:
    """(seed, node, depth): ``node`` is reached from ``seed`` in ``depth`` >= 1
    steps, following parents (``up``) or children (``down``).

    ``seeds`` is a one-column DataFrame of start ids; the result has one row
    for each seed and node it reaches, so seeds are given by the caller and
    never default to every node.  A node on a cycle reaches itself; a pair
    is reported once, at its shortest depth.

    A round extends each seed's known pairs by ``step`` levels through the
    lift table and squares the table.
    """
    if direction not in ("up", "down"):
        raise ValueError("direction must be 'up' or 'down'")
    here, there = ("v", "a") if direction == "up" else ("a", "v")
    seeds = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct()
    lift = _cut(_parents(nodes, id_col, parent_col))
    known = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).cast("bigint").alias("depth"))
    found, step = None, 1
    while True:
        # known pairs reach to depth step - 1; shifted by step they reach to 2 * step - 1
        near = (
            known.join(lift, F.col("node") == F.col(here))
            .select("seed", F.col(there).alias("node"), (F.col("depth") + F.lit(step)).alias("depth"))
            .groupBy("seed", "node").agg(F.min("depth").alias("depth"))
        )
        if found is not None:
            near = near.join(found.select("seed", "node"), ["seed", "node"], "left_anti")
        near = _cut(near)
        found = near if found is None else found.unionByName(near)
        if near.isEmpty():
            return found.select("seed", "node", F.col("depth").cast("int").alias("depth"))
        known = known.unionByName(near)
        lift = _cut(_compose(lift, lift))
        step *= 2


def ancestors(categories: DataFrame, category_id) -> DataFrame:
    """H1: the transitive parents of one category (the category excluded)."""
    seed = categories.where(F.col("id") == F.lit(category_id)).select("id")
    pairs = closure(categories, seed, "up").where(F.col("node") != F.col("seed"))
    return categories.join(pairs.select(F.col("node").alias("id")).distinct(), "id", "left_semi")


def descendants(categories: DataFrame, category_id) -> DataFrame:
    """H2: the transitive children of one category (the category excluded)."""
    seed = categories.where(F.col("id") == F.lit(category_id)).select("id")
    below = subtree(categories, seed).where(F.col("id") != F.lit(category_id))
    return categories.join(below, "id", "left_semi")


def _jump(state: DataFrame, moving, step) -> DataFrame:
    """Pointer jumping: rows for which ``moving`` holds are moved by ``step``
    (moving rows, all rows) until none is left.  Rows at rest are written once
    and kept apart; a round rewrites the moving rows only.

    A row d steps from its rest has a parent d - 1 steps from it, so after a
    round that brought no row to rest none will ever come: what still moves is
    on a parent cycle or below one, and is not returned.
    """
    state = _cut(state)
    rest, active = state.where(~moving), state.where(moving)
    left = active.count()
    while left:
        active = _cut(step(active, rest.unionByName(active)))
        rest, active, before = rest.unionByName(active.where(~moving)), active.where(moving), left
        left = active.count()
        if left == before:
            break
    return rest


def depths(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(id, depth) of every node reachable from a root (depth 0 = root).

    Nodes under a missing parent or on a parent cycle are left out, as in
    the reference's recursive query.  A row holds a pointer to an ancestor
    (NULL once it is past a root), the distance to it, and whether the way is
    sound; a round replaces the pointer by the pointer's pointer.
    """
    state = nodes.select(
        F.col(id_col).alias("id"),
        F.col(parent_col).alias("anc"),
        F.when(F.col(parent_col).isNull(), 0).otherwise(1).cast("bigint").alias("dist"),
        F.lit(True).alias("ok"),
    )

    def step(active: DataFrame, every: DataFrame) -> DataFrame:
        target = every.select(
            F.col("id").alias("t_id"), F.col("anc").alias("t_anc"), F.col("dist").alias("t_dist"), F.col("ok").alias("t_ok")
        )
        dist = F.col("dist") + F.coalesce("t_dist", F.lit(0).cast("bigint"))
        return active.join(target, F.col("anc") == F.col("t_id"), "left").select(
            "id", F.col("t_anc").alias("anc"), dist.alias("dist"),
            # a missing parent is a dead end
            (F.col("t_id").isNotNull() & F.coalesce("t_ok", F.lit(False))).alias("ok"),
        )

    done = _jump(state, F.col("anc").isNotNull() & F.col("ok"), step)
    return done.where("ok").select("id", F.col("dist").cast("int").alias("depth"))


def depth_stats(categories: DataFrame) -> DataFrame:
    """H3: depth -> category_count, by depth."""
    return depths(categories).groupBy("depth").agg(F.count(F.lit(1)).alias("category_count")).orderBy("depth")


def cycle_members(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """Ids that reach themselves by following parents (H4's condition).

    Each round replaces a node's pointer by the pointer's pointer and drops
    nodes that have run past a root.  After a round without a loss only nodes
    on and below cycles are left; once their pointers span as many steps as
    there are such nodes, every pointer lies on a cycle, and the nodes of
    a cycle point at each other one to one: the pointers are its members.
    """
    lift, step = _cut(_parents(nodes, id_col, parent_col)), 1
    size = lift.count()
    while size:
        lift, step = _cut(_compose(lift, lift)), 2 * step
        left = lift.count()
        if left == size <= step:
            break
        size = left
    return lift.select(F.col("a").alias("id")).distinct()


def _next_changed(kept: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, to): the nearest ancestor among ``changed`` ids of each row of
    ``kept`` (id, parent_id) that has one, the walk staying inside ``kept``."""
    marks = changed.select(F.col("id").alias("m_id"), F.lit(True).alias("m"))
    state = kept.join(marks, F.col("parent_id") == F.col("m_id"), "left").select(
        "id", F.col("parent_id").alias("anc"), F.coalesce("m", F.lit(False)).alias("there")
    )

    def step(active: DataFrame, every: DataFrame) -> DataFrame:
        target = every.select(F.col("id").alias("t_id"), F.col("anc").alias("t_anc"), F.col("there").alias("t_there"))
        return active.join(target, F.col("anc") == F.col("t_id"), "left").select(
            "id", F.col("t_anc").alias("anc"), F.coalesce("t_there", F.lit(False)).alias("there")
        )

    return _jump(state, F.col("anc").isNotNull() & ~F.col("there"), step).where("there").select("id", F.col("anc").alias("to"))


def reparent_conflicts(categories: DataFrame, changes: DataFrame) -> DataFrame:
    """H4 in batch: ``changes(id, parent_id)`` sets the parent of new or
    existing categories; return the changed ids that would sit on a parent
    cycle once all changes apply (made its own parent, or given one of its
    descendants as parent).

    A cycle through a changed id is a cycle among changed ids if each points at
    the next changed id above it.  So the table is walked once, up to the
    nearest changed id, and cycles are looked for among the changes only.
    """
    ch = _cut(changes.select("id", "parent_id"))
    ids = ch.select("id").distinct()
    kept = categories.select("id", "parent_id").join(ids, "id", "left_anti")
    above = _next_changed(kept, ids).select(F.col("id").alias("n_id"), "to")
    direct = ids.select(F.col("id").alias("d_id"), F.lit(True).alias("direct"))
    graph = (
        ch.where(F.col("parent_id").isNotNull())
        .join(direct, F.col("parent_id") == F.col("d_id"), "left")
        .join(above, F.col("parent_id") == F.col("n_id"), "left")
        .select("id", F.when(F.col("direct"), F.col("parent_id")).otherwise(F.col("to")).alias("parent_id"))
    )
    return ids.join(cycle_members(graph), "id", "left_semi")


def marked_by_ancestor(
    nodes: DataFrame, marks: DataFrame, id_col: str = "id", parent_col: str = "parent_id"
) -> DataFrame:
    """Ids of nodes that are marked or have a marked node on their parent
    path, by pointer jumping: each node keeps (pointer, hit) where ``hit``
    says whether the path segment up to the pointer holds a mark; a round
    replaces the pointer by the pointer's pointer and ORs the hits."""
    m = marks.select(F.col(marks.columns[0]).alias("__m"), F.lit(True).alias("__hit")).distinct()
    base = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("anc"))
    # marked ids that are not rows still count (as marked roots)
    extra = m.join(base, F.col("__m") == F.col("id"), "left_anti").select(
        F.col("__m").cast(base.schema["id"].dataType).alias("id"),
        F.lit(None).cast(base.schema["anc"].dataType).alias("anc"),
    )
    state = (
        base.unionByName(extra)
        .join(m, F.col("id") == F.col("__m"), "left")
        .select("id", "anc", F.coalesce("__hit", F.lit(False)).alias("hit"))
    )

    def step(active: DataFrame, every: DataFrame) -> DataFrame:
        target = every.select(
            F.col("id").alias("t_id"), F.col("anc").alias("t_anc"), F.col("hit").alias("t_hit")
        )
        # a missing parent ends the walk
        return active.join(target, F.col("anc") == F.col("t_id"), "left").select(
            "id", F.col("t_anc").alias("anc"), F.coalesce("t_hit", F.lit(False)).alias("hit")
        )

    return _jump(state, F.col("anc").isNotNull() & ~F.col("hit"), step).where("hit").select("id")


def subtree(
    nodes: DataFrame, seeds: DataFrame, id_col: str = "id", parent_col: str = "parent_id", within: str | None = None
) -> DataFrame:
    """H5: seeds plus every transitive child (ids only, distinct).

    ``within`` names a column that a node shares with all its descendants
    (a comment's post): only nodes of the seeds' groups are then walked.
    """
    seeds = seeds.select(F.col(seeds.columns[0]).alias("id")).distinct()
    if within is not None:
        groups = nodes.join(seeds.select(F.col("id").alias(id_col)), id_col, "left_semi").select(within).distinct()
        nodes = nodes.join(groups, within, "left_semi")
    return marked_by_ancestor(nodes.select(id_col, parent_col), seeds, id_col, parent_col)
