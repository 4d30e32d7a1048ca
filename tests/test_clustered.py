"""Clustered tables: merges, lookups and pages against plain Python."""

import datetime as dt
import os
import random

import pytest
from pyspark.errors import PySparkException

from contentlens.sources import clustered

SCHEMA = "id long, name string, at timestamp_ntz"
DAY = dt.datetime(2024, 1, 1)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def make(spark, tmp_path, ids, per_range=20, key=("id",)):
    rows = [(i, f"n{i}", DAY + dt.timedelta(hours=i % 50)) for i in ids]
    return clustered.create(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "t"), list(key), per_range), {r[0]: r for r in rows}


def test_random_merges_keep_all_versions(spark, tmp_path):
    rng = random.Random(3)
    t, want = make(spark, tmp_path, rng.sample(range(1000), 150))
    versions = [(t, dict(want))]
    for step in range(4):
        ups = [(i, f"v{step}", DAY) for i in rng.sample(range(-50, 1500), [5, 40, 0, 200][step])]
        dels = rng.sample(range(1000), 30) + [5000]
        t = clustered.merge(
            t, spark.createDataFrame(ups, SCHEMA) if ups else None,
            spark.createDataFrame([(i, "x") for i in dels] + [(None, "x")], "id int, extra string"),
        )
        for i in dels:
            want.pop(i, None)
        want |= {r[0]: r for r in ups}
        versions.append((t, dict(want)))
    for v, rows in versions:
        assert rows_of(clustered.read(v, spark)) == sorted(rows.values())
        assert clustered.count(v, spark) == len(rows)
        assert all(f["n"] <= 2 * v.rows_per_range for f in v.fences(spark))
        # ranges do not overlap
        fences = v.fences(spark)
        for f, after in zip(fences, fences[1:], strict=False):
            top = max(r[0] for r in spark.read.parquet(f"{v.path}/data/{f['folder']}").collect())
            assert f["lo"][0] <= top < after["lo"][0]


def test_a_small_batch_rewrites_few_ranges(spark, tmp_path):
    t, want = make(spark, tmp_path, range(2000))
    before = {f["folder"] for f in t.fences(spark)}
    assert len(before) == 100
    # one per cent of the rows, the newest ones
    ups = [(i, "new", DAY) for i in range(1990, 2010)]
    nxt = clustered.merge(t, spark.createDataFrame(ups, SCHEMA))
    after = {f["folder"] for f in nxt.fences(spark)}
    assert len(before - after) <= 2 and len(after - before) <= 2
    assert len(os.listdir(tmp_path / "t" / "data" / "v1")) <= 4  # with the marker files
    assert rows_of(clustered.read(t, spark)) == sorted(want.values())
    assert clustered.count(nxt, spark) == 2010


def test_lookup_opens_few_ranges(spark, tmp_path):
    t, want = make(spark, tmp_path, range(0, 2000, 2))
    keys = [4, 5, 6, 1998, 10**6, -7, None, 4]
    got = clustered.lookup(t, spark.createDataFrame([(k,) for k in keys], "id int"))
    assert rows_of(got) == sorted(want[k] for k in {4, 6, 1998})
    assert len(got.inputFiles()) <= 3


@pytest.mark.parametrize("number, size", [(1, 10), (37, 10), (100, 10), (101, 10), (3, 333), (4, 333)])
def test_pages(spark, tmp_path, number, size):
    t, want = make(spark, tmp_path, random.Random(1).sample(range(5000), 1000), 50, ("at", "id"))
    ordered = sorted(want.values(), key=lambda r: (r[2], r[0]))
    got = clustered.page(t, spark, number, size)
    assert [tuple(r) for r in got.collect()] == ordered[(number - 1) * size : number * size]
    assert len(got.inputFiles()) <= 1 + -(-size // 50) + 1


def test_text_keys_and_empty_tables(spark, tmp_path):
    rows = [(f"k{i:03}é", i) for i in range(300)]
    t = clustered.create(spark.createDataFrame(rows, "id string, n int"), str(tmp_path / "s"), ["id"], 40)
    assert rows_of(clustered.lookup(t, spark.createDataFrame([("k007é",), ("zz",)], "id string"))) == [("k007é", 7)]
    none = clustered.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"), ["id"])
    assert rows_of(clustered.read(none, spark)) == [] and clustered.page(none, spark, 1, 5).count() == 0
    assert clustered.lookup(none, spark.createDataFrame([(1,)], "id long")).count() == 0
    one = clustered.merge(none, spark.createDataFrame([(1, "a", DAY)], SCHEMA))
    assert rows_of(clustered.read(one, spark)) == [(1, "a", DAY)]
    gone = clustered.merge(one, None, spark.createDataFrame([(1,)], "id long"))
    assert rows_of(clustered.read(gone, spark)) == [] and rows_of(clustered.read(one, spark)) == [(1, "a", DAY)]


def test_null_and_odd_keys_fail(spark, tmp_path):
    with pytest.raises(PySparkException):
        clustered.create(spark.createDataFrame([(None, "a", DAY)], SCHEMA), str(tmp_path / "n"), ["id"])
    with pytest.raises(ValueError):
        clustered.create(spark.createDataFrame([(1.5,)], "id double"), str(tmp_path / "d"), ["id"])
