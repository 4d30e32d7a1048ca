"""Joins of rows whose keys are very unevenly used with a table of unique keys.

A key that more than 1/(2 P) of all rows have would make a partition of its own;
there are fewer than 2 P such keys.  P is the number of shuffle partitions, more
if those would hold too many rows each (:func:`contentlens.session.task_parts`).
The rows of these keys on the unique side are therefore a bounded broadcast, and
rows with a hot key are never shuffled.  All others go through the shuffle join,
in P partitions, in which no key can fill one.  Rows without a key match nothing
and go around both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.session import dealt, stored, task_parts


def _counted(rows: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(key, n) of all keys that are not null, and the sum of n."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))  # combined before the shuffle
    counts = stored(counts, "key-counts")
    return counts, counts.agg(F.sum("n")).first()[0] or 0


def _hot(counts: DataFrame, total: int) -> DataFrame:
    spark = counts.sparkSession
    parts = task_parts(spark, total) or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return counts.where(F.col("n") * (2 * parts) > F.lit(total))


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that more than 1/(2 P) of the rows with a key have."""
    return _hot(*_counted(rows, key))


def split_left_join(rows: DataFrame, table: DataFrame, key: str, table_key: str) -> DataFrame:
    """``rows`` left-joined with ``table`` (unique ``table_key``; column names
    apart from those of ``rows``) on ``key = table_key``, hot keys split off."""
    counts, total = _counted(rows, key)
    hot = _hot(counts, total).select(F.col(key).alias("__hot"))  # fewer than 2 P rows
    head = F.broadcast(table.join(F.broadcast(hot), F.col(table_key) == F.col("__hot"), "left_semi"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    common = marked.where(F.col("__hot").isNotNull()).drop("__hot").join(head, F.col(key) == F.col(table_key), "left")
    rest = marked.where(F.col("__hot").isNull()).drop("__hot")
    # the hint keeps the optimizer from sending the whole table to every task
    other = dealt(table, task_parts(rows.sparkSession, total), table_key).hint("merge")
    rare = rest.where(F.col(key).isNotNull()).join(other, F.col(key) == F.col(table_key), "left")
    none = rest.where(F.col(key).isNull())
    return common.unionByName(rare).unionByName(none, allowMissingColumns=True)
