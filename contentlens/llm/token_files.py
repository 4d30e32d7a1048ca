"""2. Token-id files: Parquet list columns in ascending document order.

A file set holds one row per document: ``doc_id``, ``n_tokens``,
``local_start`` (ids before it in its file), ``part`` (number of the file's
range) and ``ids``.  Ids are dictionary coded (or delta coded), the ordered
numbers are delta coded; row groups are of a set size and pages of a set
number of rows, and the writer adds page indexes, so a reader that asks for
a range of doc_id, or for the numbers alone, touches few pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contentlens.llm.common import bounded_batches, pieces_of
from contentlens.llm.tokens import RUN_BYTES, crc, encoder, with_end

FILE_SCHEMA = "doc_id long, n_tokens long, local_start long, part int, ids array<int>"


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end: int = 2,
    coding: str = "dictionary",
    row_group_bytes: int = 16 << 20,
    page_rows: int = 256,
) -> None:
    """Encode every whole text and write the file set to the new folder ``path``.

    Files hold ascending, disjoint ranges of doc_id (null ids first; rows with
    one id in the order of their texts' hash, repeated rows in any order, as
    they are equal).  A random last sort key lets a very frequent id go over
    several files.  A null text is empty: its only id is ``end``.  An empty
    table writes files without rows; further columns are not read.
    """
    if coding not in ("dictionary", "delta"):
        raise ValueError("coding is 'dictionary' or 'delta'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in pieces_of(batch, "text", RUN_BYTES):
                ids, at = with_end(*coder.encode(rows.column(1)), end)
                n = np.diff(at)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), pa.array(n), pa.array(before + at[:-1]),
                        pa.array(np.full(len(n), part, np.int32)), lists,
                    ],
                    names=["doc_id", "n_tokens", "local_start", "part", "ids"],
                )
                before += int(at[-1])

    ordered = (
        bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("hash", F.xxhash64("text"))
        .withColumn("any", F.rand(11))
        .repartitionByRange("doc_id", "hash", "any")
        .sortWithinPartitions("doc_id", "hash")
        .select("doc_id", "text")
    )
    (
        ordered.mapInArrow(run, FILE_SCHEMA).write.mode("errorifexists")
        .option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", str(coding == "dictionary").lower())
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#local_start", "false")
        .parquet(path)
    )


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, part; no ids are read.

    ``start`` counts the ids of all documents before: the file's own count
    plus the total of the files before it (one row for each file).
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    return _started(rows.select("doc_id", "n_tokens", "local_start", "part"), rows).select("doc_id", "start", "n_tokens", "part")


def _started(df: DataFrame, rows: DataFrame) -> DataFrame:
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    # one row per written file: bounded by the number of files
    return df.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("local_start"))


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids of the documents first..last (all by default); the
    bounds reach the scan, where page indexes skip other pages."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows.select("doc_id", "n_tokens", "ids")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [crc(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.diff(at).astype(np.int64)),
                    batch.column(1), batch.column(2), pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "n_tokens", "local_start", "part", "ids_crc32"],
            )

    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    got = rows.select("doc_id", "local_start", "part", "ids").mapInArrow(
        run, "doc_id long, n_tokens long, local_start long, part int, ids_crc32 long"
    )
    return _started(got, rows).select("doc_id", "start", "n_tokens", "ids_crc32")
