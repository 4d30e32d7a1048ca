"""The pipeline: each stage against what its operator decides, whole and odd input."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contentlens.llm import jaccard_join, quality
from contentlens.llm.common import stored, table
from contentlens.llm.decontamination import contaminated

SF = "/root/testdata/sf0.01"


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_stages_keep_columns_and_only_remove(steps):
    for a, b in zip(steps[:3], steps[1:4], strict=True):
        assert b.columns == a.columns and not rows(b) - rows(a)
    assert steps[4].columns == steps[0].columns and steps[4].count() == steps[3].count()


def test_quality_stage(spark, steps):
    model = quality.fit(steps[0], table(spark, SF, "labels"))
    keep = {r.doc_id for r in quality.posteriors(steps[0], model).where("keep").collect()}
    assert {r.doc_id for r in steps[1].select("doc_id").collect()} == keep
    bad = table(spark, SF, "labels").join(steps[1], "doc_id").where("quality = 0").count()
    assert bad <= 1


def test_near_duplicate_stage(spark, steps):
    classes = jaccard_join.jaccard_classes(steps[1])
    assert {r.doc_id for r in steps[2].collect()} == {r.class_id for r in classes.collect()}
    assert jaccard_join.jaccard_classes(steps[2]).where("n_links > 0").count() == 0


def test_decontamination_stage(spark, steps):
    found = {r.doc_id for r in contaminated(steps[2], table(spark, SF, "benchmark")).collect()}
    assert {r.doc_id for r in steps[3].collect()} == {r.doc_id for r in steps[2].collect()} - found and found
    assert contaminated(steps[3], table(spark, SF, "benchmark")).count() == 0


def test_pii_stage(steps):
    assert steps[4].where(F.col("text").rlike(r"555-\d{4}")).count() <= 5
    clean = steps[3].where(~F.col("text").rlike(r"[\d@]"))
    assert not rows(clean) - rows(steps[4])


def test_pii_stage_changes_every_phone(steps):
    phone = re.compile(r"\+1 \(\d{3}\) 555-\d{4}")
    before, after = ({r.doc_id: r.text or "" for r in s.select("doc_id", "text").collect()} for s in (steps[3], steps[4]))
    planted = {d: phone.findall(t) for d, t in before.items() if phone.search(t)}
    assert planted
    for d, found in planted.items():
        assert not [p for p in found if p in after[d]]


def test_run_packs_what_is_left(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    left = {r.doc_id for r in steps[4].collect()}
    per_doc = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert {r.doc_id for r in per_doc} == left and all(r.n == r.m for r in per_doc)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    text = " ".join(rng.choices([f"word{i}" for i in range(300)], k=200)) + "."
    odd = [
        (1, None, None, None, 0, "q"), (2, "", "en", "s", 0, "q"), (3, text, "en", "s", 9, "q"), (3, text, "en", "s", 9, "q"), (4, text + " tail", "en", "s", 9, None),
        (None, text.upper(), "en", "s", 9, "q"), (None, "a lone text without an id", "en", "s", 9, "q"), (5, text[:500] + " different end " * 40, "en", "s", 9, "q"),
        (5, "another text with the same id as the one before it, mail a.12@mail1.example.com", "en", "s", 9, "q"), (6, "long words " * 30000, "en", "s", 9, "q"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, q_keep string"
    folder = str(tmp_path)
    spark.createDataFrame([(3, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "nothing like it at all in here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame(odd, schema)
    assert corpus_pipeline.keep_good(spark, docs, folder).columns == docs.columns
    one = corpus_pipeline.keep_one_of_each_class(spark, docs, folder)
    assert one.columns == docs.columns
    left = Counter(r.doc_id for r in one.collect())
    assert left == {1: 1, 2: 1, 3: 1, None: 1, 5: 2, 6: 1}
    assert rows(corpus_pipeline.drop_contaminated(spark, docs, folder)) == rows(docs)
    assert corpus_pipeline.replace_pii(spark, docs, folder).count() == len(odd)
    assert corpus_pipeline.pack_sequences(spark, docs, folder).agg(F.sum("length")).first()[0] > 0
    none = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
