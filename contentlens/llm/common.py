"""Small helpers that several operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlens.operators import components
from contentlens.session import ensure_checkpoint_dir

#: A word: letters (with their marks) and digits; everything else separates words.
WORD_SPLIT = r"[^\p{L}\p{M}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers.

    Workers of a local session share the driver's working folder and PYTHONPATH,
    and nothing is done where the package lies in one of them.  What the
    workers of a cluster have is not known here, so its sources are added to the
    session, once, as a small zip file that Spark hands to every executor.
    """
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    near = context.master == "local" or context.master.startswith("local[")
    if context.applicationId in _SENT or near and any(p and Path(p).resolve() == root for p in found):
        return
    path = Path(tempfile.mkdtemp(prefix="contentlens-code-")) / "contentlens.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "contentlens").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(path))
    _SENT.add(context.applicationId)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back (cuts lineage)."""
    path = work_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Most bytes of a batch that a Python worker gets; texts are long, and a
#: worker holds a batch several times over.
BATCH_BYTES = 8 << 20


def byte_count(size: str) -> int:
    """Bytes of a size as Spark writes it: ``64m``, ``1g``, ``8388608b``, ``4096``."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", size.lower()).groups()
    powers = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40, "p": 50, "pb": 50}
    return int(number) << powers[unit]


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, about to go to Python workers: the package is sent where they lack
    it, and the session's Arrow batches are bounded to BATCH_BYTES from now on
    (a smaller bound stays; plans read the setting when they run, so it is not
    set back).  A single text beyond the bound is a batch of its own, and a
    worker holds it several times over."""
    send_package(df.sparkSession)
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < byte_count(conf.get(key, str(8 * BATCH_BYTES))) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, with a mark more where ``df`` has such columns already."""
    have = {c.lower() for c in df.columns}
    while any(n.lower() in have for n in names):
        names = tuple(f"{n}_" for n in names)
    return list(names)


#: Keys that are broadcast at most (two numbers each); more are joined by a shuffle.
BROADCAST_KEYS = 100_000


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, hash of the text) is not among ``keys``
    (doc_id, th), which are stored.  Null ids are equal to each other."""
    k_id, k_th = free_names(docs, "k_id", "k_th")
    keys = keys.select(F.col("doc_id").alias(k_id), F.col("th").alias(k_th)).distinct()
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("shuffle_hash")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(k_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(k_th))
    return docs.join(keys, same, "left_anti")


def pieces_of(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose ``column`` holds about ``limit`` bytes
    (at least one row each), which bounds what a task works on at once."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes, dtype=np.int64) // max(1, limit)
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), n]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(lo, hi - lo)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, root): the least vertex of each vertex's component, in a
    logarithmic number of rounds.  Null ends and loops are dropped."""
    return components.connected_components(edges.where(F.col(a) != F.col(b)), a, b)


def sorted_groups(
    batches: Iterator[pa.RecordBatch], key: str, act: Callable[[pa.Table], pa.Table | None], at_least: int = 20_000
) -> Iterator[pa.RecordBatch]:
    """Feed ``act`` whole groups of a partition that is sorted by ``key``.

    ``act`` gets tables that hold one or more whole groups (many small groups
    at once, so that a group costs little); what it returns is yielded.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(parts):
        if parts and (out := act(pa.Table.from_batches(parts))) is not None:
            yield from out.to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key))
        if held and rows >= at_least:
            last = held[-1].column(held[-1].schema.get_field_index(key))[-1]
            same = pc.equal(keys, last).fill_null(False).to_numpy(zero_copy_only=False)
            cut = int(same.argmin()) if not same.all() else len(same)
            if cut < len(same):
                yield from flush([*held, batch.slice(0, cut)] if cut else held)
                held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    yield from flush(held)
