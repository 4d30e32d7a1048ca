"""Tables clustered by key ranges, with counted fences.

A clustered table is a set of ranges of its key.  Each range is a folder of
sorted Parquet files that is never changed once written; a version is a small
table of fences: for each range its first key, its number of rows and its
folder.  With the fences known,

* a batch of changes rewrites the ranges that it touches and shares all other
  folders with the version before, which stays readable (:func:`merge`),
* looking up keys opens the ranges that may hold them (:func:`lookup`),
* page N of a listing in key order is found by the counts and read from the
  ranges it lies in, however deep it is (:func:`page`).

A new table has at most MAX_RANGES ranges (larger tables have larger ranges), and
merges cut larger ranges as it grows, about MAX_RANGES more each time it doubles,
so the fences are a list that the driver can hold.  One writer at a time; a
version exists once its fences are written, which is the last step.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentlens.session import stored

ROWS_PER_RANGE = 1_000_000
MAX_RANGES = 10_000
KEY_TYPES = ("long", "integer", "short", "byte", "string", "date", "timestamp_ntz")


@dataclass(frozen=True)
class Clustered:
    """A version of a clustered table."""

    path: str
    key: tuple[str, ...]
    version: int
    schema: T.StructType
    rows_per_range: int

    def fences(self, spark: SparkSession) -> list[dict]:
        """lo (first key), n (rows), folder of each range, in key order."""
        rows = spark.read.parquet(f"{self.path}/fences/v{self.version}").collect()
        return sorted(({"lo": tuple(r["lo"]), "n": r["n"], "folder": r["folder"]} for r in rows), key=lambda r: r["lo"])

    def at(self, version: int) -> Clustered:
        return replace(self, version=version)


def _rows_of(t: Clustered, spark: SparkSession, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], t.schema)
    return spark.read.schema(t.schema).parquet(*[f"{t.path}/data/{f}" for f in folders])


def read(t: Clustered, spark: SparkSession) -> DataFrame:
    """All rows of this version."""
    return _rows_of(t, spark, [f["folder"] for f in t.fences(spark)])


def _write_pieces(pieces: DataFrame, t: Clustered) -> list[dict]:
    """Write rows (with ``__piece``, of one range each) under this version and
    describe the new ranges."""
    folder = f"v{t.version}"
    pieces.write.partitionBy("__piece").parquet(f"{t.path}/data/{folder}")
    written = pieces.sparkSession.read.schema(T.StructType([*t.schema.fields, T.StructField("__piece", T.StringType())])).parquet(f"{t.path}/data/{folder}")
    found = written.groupBy("__piece").agg(F.min(F.struct(*t.key)).alias("lo"), F.count(F.lit(1)).alias("n")).collect()  # one row a new range
    return [{"lo": tuple(r["lo"]), "n": r["n"], "folder": f"{folder}/__piece={r['__piece']}"} for r in found]


def _commit(t: Clustered, spark: SparkSession, fences: list[dict]) -> Clustered:
    kind = T.StructType([
        T.StructField("lo", T.StructType([t.schema[k] for k in t.key])), T.StructField("n", T.LongType()), T.StructField("folder", T.StringType()),
    ])
    spark.createDataFrame([(f["lo"], f["n"], f["folder"]) for f in fences], kind).coalesce(1).write.parquet(f"{t.path}/fences/v{t.version}")
    return t


def _check_keys(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    missing = F.lit(False)
    for k in key:
        missing = missing | F.col(f"`{k}`").isNull()
    first = F.when(missing, F.raise_error(F.lit("clustered table: a row has no key")).cast(rows.schema[key[0]].dataType)).otherwise(F.col(f"`{key[0]}`"))
    return rows.withColumn(key[0], first)


def create(rows: DataFrame, path: str, key: list[str], rows_per_range: int = ROWS_PER_RANGE) -> Clustered:
    """Write ``rows`` as version 0 of a new clustered table.  Keys are unique and
    not null (a null key fails the job), of types that Python orders as Spark
    does: whole numbers, text, dates, timestamps without a zone."""
    spark = rows.sparkSession
    if odd := [k for k in key if rows.schema[k].dataType.typeName() not in KEY_TYPES]:
        raise ValueError(f"key columns {odd} have a type that cannot be fenced")
    total = rows.count()
    per_range = max(rows_per_range, -(-total // MAX_RANGES))
    t = Clustered(path, tuple(key), 0, rows.schema, per_range)
    dealt = _check_keys(rows, t.key).repartitionByRange(max(1, -(-total // per_range)), *key).sortWithinPartitions(*key)
    return _commit(t, spark, _write_pieces(dealt.withColumn("__piece", F.spark_partition_id().cast("string")), t) if total else [])


def _ranged(rows: DataFrame, key: tuple[str, ...], fences: list[dict]) -> DataFrame:
    """``rows`` with ``__range``: the place of the range (by its first key) that
    has or would have each row; keys before the first go to the first."""
    firsts = [f["lo"] for f in fences[1:]]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in key]
            place = [bisect_right(firsts, k) for k in zip(*cols)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int32())], names=[*batch.schema.names, "__range"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("__range", T.IntegerType())]))


def lookup(t: Clustered, keys: DataFrame) -> DataFrame:
    """Rows whose key is among ``keys`` (columns of the key); only the ranges that
    may hold them are read.  Null keys match nothing."""
    spark = keys.sparkSession
    fences = t.fences(spark)
    keys = keys.select(*[F.col(f"`{k}`").cast(t.schema[k].dataType).alias(k) for k in t.key]).dropna().distinct()
    if not fences:
        return _rows_of(t, spark, [])
    keys = stored(_ranged(keys, t.key, fences), "keys")
    touched = sorted(r[0] for r in keys.select("__range").distinct().collect())  # MAX_RANGES at most
    return _rows_of(t, spark, [fences[k]["folder"] for k in touched]).join(keys.select(*t.key), list(t.key), "left_semi")


def merge(t: Clustered, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> Clustered:
    """The next version: rows of ``upserts`` (all columns; one per key) replace or
    add, keys of ``deletes`` go; a key in both is replaced.

    Only touched ranges are read and written.  A range that has grown beyond
    twice its size is cut into several.
    """
    spark = (upserts if upserts is not None else deletes).sparkSession
    fences = t.fences(spark)
    names = [f.name for f in t.schema.fields]
    new = spark.createDataFrame([], t.schema) if upserts is None else _check_keys(upserts, t.key)
    new = new.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in t.schema.fields])
    gone = new.select(*t.key) if deletes is None else new.select(*t.key).unionByName(
        deletes.select(*[F.col(f"`{k}`").cast(t.schema[k].dataType).alias(k) for k in t.key]).dropna()
    )
    new = stored(_ranged(new, t.key, fences), "upserts")
    gone = stored(_ranged(gone.distinct(), t.key, fences), "gone")
    touched = sorted(r[0] for r in gone.select("__range").distinct().collect())  # MAX_RANGES at most
    old = [fences[k] for k in touched if k < len(fences)]
    kept = _ranged(_rows_of(t, spark, [f["folder"] for f in old]).join(gone.select(*t.key), list(t.key), "left_anti"), t.key, fences)
    rows = kept.select(*names, "__range").unionByName(new.select(*names, "__range"))
    size = {r["__range"]: r["n"] for r in rows.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect()}  # MAX_RANGES at most
    total = sum(f["n"] for f in fences) - sum(f["n"] for f in old) + sum(size.values())
    nxt = replace(t, version=t.version + 1, rows_per_range=max(t.rows_per_range, -(-total // MAX_RANGES)))
    large = [k for k, n in size.items() if n > 2 * nxt.rows_per_range]
    order = ["__range", *t.key]
    small = [k for k in size if k not in large]
    pieces = rows.where(~F.col("__range").isin(large)).repartition(max(1, len(small)), "__range").sortWithinPartitions(*order)
    pieces = pieces.withColumn("__piece", F.col("__range").cast("string"))
    if large:
        parts = sum(-(-size[k] // nxt.rows_per_range) for k in large)
        cut = rows.where(F.col("__range").isin(large)).repartitionByRange(parts, *order).sortWithinPartitions(*order)
        cut = stored(cut.withColumn("__piece", F.concat_ws("_", "__range", F.spark_partition_id())), "cut")
        pieces = pieces.unionByName(cut.repartition(parts, "__piece").sortWithinPartitions("__piece", *t.key))
    made = _write_pieces(pieces.drop("__range"), nxt) if size else []
    left = [f for k, f in enumerate(fences) if k not in set(touched)]
    return _commit(nxt, spark, left + made)


def page(t: Clustered, spark: SparkSession, number: int, size: int) -> DataFrame:
    """P1 in key order: rows (number - 1) * size and following.  The counts of
    the fences tell in which ranges they lie; only these are read."""
    skip, before, folders, start = (number - 1) * size, 0, [], 0
    for f in t.fences(spark):
        if before + f["n"] > skip and before < skip + size:
            start = start if folders else before
            folders.append(f["folder"])
        before += f["n"]
    return _rows_of(t, spark, folders).orderBy(*t.key).offset(max(0, skip - start)).limit(size)


def count(t: Clustered, spark: SparkSession) -> int:
    """Rows of the version, by its fences (P2 without a scan)."""
    return sum(f["n"] for f in t.fences(spark))
