"""Table snapshots (S1 scan, S3 write).

A snapshot is a folder holding one Parquet dataset per table.  Writes always
go to a *new* folder: the plans are lazy, so overwriting the folder a plan is
still reading would corrupt it.

S2 (the relational source of the reference) is Spark's built-in JDBC reader;
no code is needed beyond::

    spark.read.jdbc(url, "posts", column="created_at", lowerBound=..,
                    upperBound=.., numPartitions=64, properties=...)

then ``conform(df, "posts")`` to apply the declared schema.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlens.schema import TABLE_SCHEMAS

# Columns that never leave the source (credentials).
DROPPED_ON_LOAD = {"users": ("hashed_password",)}


@dataclass(frozen=True)
class ContentTables:
    users: DataFrame
    categories: DataFrame
    posts: DataFrame
    comments: DataFrame
    comment_likes: DataFrame

    def with_(self, **changes: DataFrame) -> "ContentTables":
        return replace(self, **changes)

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def register_views(tables: ContentTables, prefix: str = "") -> None:
    """Expose the tables to ``spark.sql`` as temp views (``users``,
    ``categories``, ``posts``, ``comments``, ``comment_likes``)."""
    for name, df in tables.as_dict().items():
        df.createOrReplaceTempView(f"{prefix}{name}")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select and cast ``df`` to the declared schema of ``table``.

    Declared columns missing from ``df`` become typed NULLs; undeclared
    columns (and credentials) are dropped.  Key columns (``id``, ``*_id``)
    keep the type of the source when that is text, so UUID keys work.
    """
    schema = TABLE_SCHEMAS[table]
    present = {c.lower(): c for c in df.columns}
    cols = []
    for field in schema.fields:
        src = present.get(field.name.lower())
        expr = F.col(f"`{src}`") if src else F.lit(None)
        key = field.name == "id" or field.name.endswith("_id")
        text = src is not None and df.schema[src].dataType.typeName() == "string"
        cols.append(expr.cast("string" if key and text else field.dataType).alias(field.name))
    return df.select(*cols)


def load_tables(spark: SparkSession, path: str) -> ContentTables:
    """Scan a snapshot folder written by :func:`save_tables`."""
    frames = {}
    for name in TABLE_SCHEMAS:
        df = spark.read.parquet(f"{path}/{name}")
        df = df.drop(*DROPPED_ON_LOAD.get(name, ()))
        frames[name] = conform(df, name)
    return ContentTables(**frames)


def save_tables(
    tables: ContentTables,
    path: str,
    partition_by: dict[str, list[str]] | None = None,
) -> None:
    """S3: write every table of a snapshot into a new folder ``path``.

    ``partition_by`` optionally maps table name to Hive partition columns
    (for example a created-date column) so later scans can prune folders.
    """
    partition_by = partition_by or {}
    for name, df in tables.as_dict().items():
        writer = df.write.mode("errorifexists")
        if partition_by.get(name):
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(f"{path}/{name}")
