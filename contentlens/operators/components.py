"""Connected components of an edge list, in a logarithmic number of rounds.

Every vertex points to a vertex of its component with a lesser or equal id.  A
round looks at the pointer's pointer of each vertex and its neighbours, takes
the least, and gives it to the vertex *and* to the vertex it points at (so
whole trees are hooked at their roots), while pointers jump to their pointer's
pointer.  The distance covered doubles from round to round, whatever the
order of the ids: a path of n vertices takes about log2(n) + 1 rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.session import stored


def both_ways(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(u, v): each edge in both directions, once; loops give (u, u)."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    return e.union(e.select("v", "u")).distinct()


def hook_round(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(vertex, root, was) after one round over ``labels`` (vertex, root).

    A hub's neighbours are combined before the shuffle, and so are the
    proposals for a root that many vertices point at.
    """
    up = labels.join(labels.select(F.col("vertex").alias("root"), F.col("root").alias("up")), "root")
    near = edges.join(up.select(F.col("vertex").alias("v"), "up"), "v").groupBy("u").agg(F.min("up").alias("near"))
    low = up.join(near, F.col("vertex") == F.col("u"), "left").select(
        "vertex", "root", F.least("up", F.coalesce("near", "up")).alias("low")
    )
    own = F.struct(F.col("vertex").alias("vertex"), F.col("root").alias("was"), F.col("low"))
    hook = F.struct(F.col("root").alias("vertex"), F.when(F.lit(False), F.col("root")).alias("was"), F.col("low"))
    told = low.select(F.explode(F.array(own, hook)).alias("p")).select("p.*")
    return told.groupBy("vertex").agg(F.min("low").alias("root"), F.max("was").alias("was"))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, root): the least vertex of the component of each vertex of
    ``edges`` (columns ``a``, ``b`` of one ordered type).  Edges with a null
    end are dropped; a loop names a vertex that may be alone.

    Each round is written to the shared folder, so that a lost executor repeats
    one round; rounds end when no pointer has changed.
    """
    edges = stored(both_ways(edges, a, b), "edges")
    labels = stored(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("vertex"), F.least("u", "m").alias("root")), "labels")
    edges = edges.where("u <> v")
    while True:
        step = stored(hook_round(edges, labels), "labels")
        labels = step.select("vertex", "root")
        if step.where("root < was").isEmpty():
            return labels
