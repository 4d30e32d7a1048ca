import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from contentlens.session import BASE_CONF

    builder = SparkSession.builder.master("local[*]").appName("contentlens-tests")
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g")
    # Tests own the checkpoint folder (a cluster names a shared one).
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="contentlens-test-ckpt-"))
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows(df, *cols):
    """Sorted list of tuples of the given columns (all when none given)."""
    cols = cols or tuple(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_null_first)


def _null_first(row):
    return tuple((v is not None, v) for v in row)
