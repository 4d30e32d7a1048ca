"""Shared helpers: clashing names, sizes, packages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contentlens.llm import common, decontamination, jaccard_join, quality, toxicity


def documents(spark, extra):
    """Documents with more columns, named as an operator's own."""
    rows = [(i, f"text number {i} " + "with some more words in it " * (i % 4 + 1), "en", f"host{i % 3}") for i in range(40)]
    rows += [(100, "*** !!! ***", "en", "h"), (101, "*** !!! ***", "en", "h"), (102, "+++", "en", "h"), (103, rows[5][1], "en", "h"), (104, "", "en", "h"), (105, "", "en", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in extra:
        df = df.withColumn(c, F.lit("x"))
    return df


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(40)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "text number 7 with some more words in it")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


CLASHES = ["l_id", "l_label", "label", "k_id", "k_th", "k_id_", "k_th_", "s_path", "s_path_", "s_rate_", "s_n_", "s_good_", "th", "sid", "sig", "grams", "kept", "vertex", "root"]


def test_clashing_columns(spark, folder):
    docs = documents(spark, CLASHES)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert quality.fit(docs, labels).weights is not None
    toxicity.fit(docs, labels)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    assert corpus_pipeline.pack_sequences(spark, docs, folder).count() > 0
    model = quality.fit(docs, labels)
    judged = quality.posteriors(docs, model, prefix="q_", texts=True).collect()
    plain = {r.doc_id: r.posterior for r in quality.posteriors(documents(spark, []), model).collect()}
    assert {r.doc_id: r.q_posterior for r in judged} == pytest.approx(plain)


def test_equal_texts_without_words_are_one_class(spark):
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(documents(spark, [])).collect()}
    assert got[100] == (100, 1) and got[101] == (100, 1) and got[102] == (102, 0) and got[103] == (5, got[5][1])
    assert got[104] == (104, 0) and got[105] == (105, 0)
    left = {r.doc_id for r in jaccard_join.one_of_each_class(documents(spark, ["sid", "root"])).collect()}
    assert {100, 102, 104, 105} <= left and not {101, 103} & left


def test_clean_keeps_the_rest(spark, folder):
    docs = documents(spark, ["k_id", "k_th"])
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = {r.doc_id for r in decontamination.contaminated(docs, items).collect()}
    assert 7 in found
    assert {r.doc_id for r in decontamination.clean(docs, items).collect()} == {r.doc_id for r in docs.collect()} - found


@pytest.mark.parametrize("size, n", [("64m", 64 << 20), ("1g", 1 << 30), ("8388608b", 8 << 20), ("4096", 4096), (" 2 kb ", 2048), ("1TB", 1 << 40)])
def test_sizes(size, n):
    assert common.byte_count(size) == n


@pytest.mark.parametrize("given, bound", [("64m", 8 << 20), ("1g", 8 << 20), ("1m", 1 << 20), ("4096", 4096)])
def test_batches_are_bounded(spark, given, bound):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, given)
    try:
        common.bounded_batches(spark.range(1))
        assert common.byte_count(spark.conf.get(key)) == bound
    finally:
        spark.conf.unset(key)
