"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every contentlens job relies on: UTC wall clock for calendar-day
# and hour bucketing, AQE for runtime join/partition decisions and skew splits.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # checkpoint files go with the plans that read them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    app: str = "contentlens",
    cpus: int | str = "*",
    shuffle_partitions: int = 8,
    driver_memory: str = "8g",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Local session for tests and benchmarks (a cluster passes its own)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by the deployment (a shared file
    system every executor can reach).  Only a local-mode session without the
    setting gets a private scratch folder, since there the driver is the only
    machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(for example on the cluster's distributed file system)"
        )
    path = tempfile.mkdtemp(prefix="contentlens-ckpt-", dir=os.environ.get("TMPDIR"))
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to a new place in the shared checkpoint folder and
    read it back.  Like a checkpoint it cuts the lineage, but the optimizer knows
    the size of what it reads, and columns are pruned."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Target bytes per shuffle / scan partition: large enough to amortise task
# overhead, small enough to sort and aggregate in an executor slot without
# heavy spilling.
TARGET_PARTITION_BYTES = 256 * 1024 * 1024


# Map outputs times reducers that one driver can track; more partitions than
# this make the map-output table, not the data, the bottleneck.
MAX_SHUFFLE_PARTITIONS = 50_000


# Rows that one task of a shuffle join or aggregate holds at most, on average:
# some 40 MB for each sort or hash table of the task.
ROWS_PER_TASK = 1 << 19


def task_parts(spark: SparkSession, rows: int) -> int:
    """Partitions that a shuffle of ``rows`` rows needs for tasks of ``ROWS_PER_TASK``
    rows, or 0 if the session's number does, also once AQE has coalesced it to
    the number of cores."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(-(-rows // ROWS_PER_TASK), MAX_SHUFFLE_PARTITIONS)
    return max(own, wanted) if wanted > min(own, spark.sparkContext.defaultParallelism) else 0


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``df`` in ``parts`` (of :func:`task_parts`) partitions by ``keys``; as it is
    for 0.  A join takes the number over from one side, so the smaller one is
    dealt: if that is broadcast, the larger one is not shuffled for nothing."""
    return df.repartition(parts, *keys) if parts else df


def cluster_conf(shuffle_bytes: int, executors: int, cores_per_executor: int) -> dict[str, str]:
    """Settings for a cluster session.

    ``shuffle_bytes`` is what the largest exchange moves after column pruning,
    filters and partial aggregation, not the size of the input.  Partitions
    follow it (at least two waves of tasks over all cores); AQE coalesces
    small ones and splits skewed ones at run time.  Example: 5 TB shuffled of
    100 TB read, on 1000 executors x 8 cores, gives 20k partitions of 256 MB;
    beyond 50k, partitions grow instead and spill to local disk.
    """
    cores = max(1, executors * cores_per_executor)
    wanted = max(2 * cores, -(-int(shuffle_bytes) // TARGET_PARTITION_BYTES))
    partitions = min(wanted, max(2 * cores, MAX_SHUFFLE_PARTITIONS))
    return {
        **BASE_CONF,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(TARGET_PARTITION_BYTES),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TARGET_PARTITION_BYTES // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(TARGET_PARTITION_BYTES),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        # broadcast only what is measured to be small
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    }
