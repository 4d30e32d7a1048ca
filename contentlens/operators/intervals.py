"""Interval labels of a forest (H1, H2, H5 as range predicates).

Every node gets its number on a walk through the forest, parents before
children and siblings in the order of their ids (``enter``), and the number of
its last descendant (``leave``).  With the labels stored beside the table,

* the ancestors of a node are the nodes whose interval holds its number,
* its descendants are the nodes whose number lies in its interval,
* a subtree's size is the length of its interval,

so walks of any depth are comparisons of numbers.  Making the labels takes
two doubling passes of about log2(depth) rounds and one running total over
siblings, which is exact for a parent with any number of children.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.operators.ordered import running_max, running_totals
from contentlens.session import stored

LABELS = ("depth", "enter", "leave")


def _sizes(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, parent, depth, size): nodes under a root, with the number of nodes
    of their subtree.

    After a round that covers ``step`` levels, ``anc`` is the ancestor that many
    levels up (null: past a root) and ``size`` counts the descendants less than
    ``step`` levels down.  The next round adds, for every node, the sizes of
    the nodes exactly ``step`` below it.  A round that settles no further node
    is the last: what still moves is on a parent cycle or below one.
    """
    given = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
    state = given.select(
        "id", "parent", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("size"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.lit(True).alias("sound"),
    )
    state = stored(state, "sizes")
    moving = F.col("anc").isNotNull()
    active = state.where(moving).count()
    while active:
        up = state.select(
            F.col("id").alias("t_id"), F.col("anc").alias("t_anc"), F.col("depth").alias("t_depth"), F.col("sound").alias("t_sound")
        )
        below = state.where(moving).groupBy("anc").agg(F.sum("size").alias("more"))  # combined before the shuffle
        step = (
            state.join(up, F.col("anc") == F.col("t_id"), "left")
            .select(
                "id", "parent", F.col("t_anc").alias("anc"), "size",
                (F.col("depth") + F.coalesce("t_depth", F.lit(0).cast("long"))).alias("depth"),
                # a parent that is no row is a dead end
                (F.col("sound") & (~moving | F.coalesce(F.col("t_sound"), F.lit(False)))).alias("sound"),
            )
            .join(below.select(F.col("anc").alias("b_id"), "more"), F.col("id") == F.col("b_id"), "left")
            .select("id", "parent", "anc", (F.col("size") + F.coalesce("more", F.lit(0).cast("long"))).alias("size"), "depth", "sound")
        )
        state = stored(step, "sizes")
        left = state.where(moving).count()
        if left == active:
            break
        active = left
    return state.where(~moving & F.col("sound")).select("id", "parent", "depth", "size")


def interval_labels(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(id, depth, enter, leave) of the nodes under a root; ids are unique.

    Numbers run from 0 over the whole forest.  Nodes on a parent cycle, below one
    or below a missing parent have no place in a forest and are left out.
    """
    sizes = stored(_sizes(nodes, id_col, parent_col), "sized")
    sibling = running_totals(sizes, ["parent"], ["id"], "size", "before")
    # the first child comes right after its parent; the first root is 0
    hop = F.col("before") + F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long")
    state = stored(sibling.select("id", F.col("parent").alias("anc"), "depth", "size", hop.alias("enter")), "hops")
    moving = F.col("anc").isNotNull()
    rest, active = state.where(~moving), state.where(moving)
    while not active.isEmpty():
        up = rest.unionByName(active).select(F.col("id").alias("t_id"), F.col("anc").alias("t_anc"), F.col("enter").alias("t_enter"))
        step = active.join(up, F.col("anc") == F.col("t_id")).select(
            "id", F.col("t_anc").alias("anc"), "depth", "size", (F.col("enter") + F.col("t_enter")).alias("enter")
        )
        step = stored(step, "hops")
        rest, active = rest.unionByName(step.where(~moving)), step.where(moving)
    return rest.select("id", F.col("depth").cast("int").alias("depth"), "enter", (F.col("enter") + F.col("size") - 1).alias("leave"))


def _interval(labels: DataFrame, node) -> tuple[int, int] | None:
    row = labels.where(F.col("id") == F.lit(node)).select("enter", "leave").first()  # one row
    return (row["enter"], row["leave"]) if row else None


def ancestors_by_interval(labels: DataFrame, node) -> DataFrame:
    """H1 on stored labels: label rows of all ancestors of ``node`` (without it)."""
    own = _interval(labels, node)
    return labels.where(F.lit(False)) if own is None else labels.where((F.col("enter") < own[0]) & (F.col("leave") >= own[0]))


def descendants_by_interval(labels: DataFrame, node) -> DataFrame:
    """H2 on stored labels: label rows of all descendants of ``node`` (without it)."""
    own = _interval(labels, node)
    return labels.where(F.lit(False)) if own is None else labels.where((F.col("enter") > own[0]) & (F.col("enter") <= own[1]))


def subtrees_by_interval(labels: DataFrame, seeds: DataFrame) -> DataFrame:
    """H5 on stored labels, in bulk: ids of ``seeds`` (one column) and of all
    their descendants, each once.

    A node lies in some seed's subtree iff the largest ``leave`` of the seeds
    that were entered before it (or with it) reaches it: one running maximum in
    the order of ``enter``.
    """
    s = seeds.select(F.col(seeds.columns[0]).alias("s_id")).where("s_id IS NOT NULL").distinct()
    marked = labels.join(s, F.col("id") == F.col("s_id"), "left").select(
        "id", "enter", F.when(F.col("s_id").isNotNull(), F.col("leave")).alias("mark")
    )
    return running_max(marked, ["enter"], "mark", "reach").where("reach >= enter").select("id")
