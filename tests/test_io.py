"""A snapshot written to a new folder loads back conformed."""

import tempfile

import pytest
from pyspark.sql import functions as F

from contentlens.schema import TABLE_SCHEMAS
from contentlens.sources.fixtures import content_tables
from contentlens.sources.tables import load_tables, save_tables


def test_snapshot_round_trip(spark):
    t = content_tables(spark, "/root/testdata/sf0.001")
    t = t.with_(users=t.users.withColumn("hashed_password", F.lit("x")))
    root = tempfile.mkdtemp(prefix="contentlens-snap-")
    save_tables(t, f"{root}/v1")
    back = load_tables(spark, f"{root}/v1")
    for name, df in back.as_dict().items():
        assert df.schema == TABLE_SCHEMAS[name], name
        assert df.count() == t.as_dict()[name].count(), name
    assert "hashed_password" not in back.users.columns
    with pytest.raises(Exception):
        save_tables(t, f"{root}/v1")  # never overwrite a snapshot folder


def test_partitioned_snapshot(spark):
    t = content_tables(spark, "/root/testdata/sf0.001")
    t = t.with_(comments=t.comments.withColumn("created_date", F.to_date("created_at")))
    root = tempfile.mkdtemp(prefix="contentlens-snap-")
    save_tables(t, f"{root}/v2", partition_by={"comments": ["created_date"]})
    back = spark.read.parquet(f"{root}/v2/comments").where(F.col("created_date") == "2024-01-05")
    assert back.count() == t.comments.where(F.to_date("created_at") == "2024-01-05").count()
    assert "PartitionFilters: [isnotnull(created_date" in back._jdf.queryExecution().executedPlan().toString()
