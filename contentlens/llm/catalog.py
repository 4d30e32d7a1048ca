"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from contentlens.llm import decontamination, hard_negatives, languages, lm_scores, quality, toxicity
from contentlens.llm.common import send_package, table, work_folder
from contentlens.llm.edit_counts import counts_after_edits, routine_edits
from contentlens.llm.fingerprints import fingerprint_edits
from contentlens.llm.jaccard_join import jaccard_classes
from contentlens.llm.packing import pack
from contentlens.llm.pii import pseudonymise
from contentlens.llm.spelling import variants_of_documents
from contentlens.llm.token_files import checksums, write_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        send_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def tokenizer_file() -> str:
    return corpus_pipeline.tokenizer_file()


@query
def op1_pack_sequences(spark, sf_dir):
    """All documents packed into sequences of 2048 ids (end id 1)."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_file(), capacity=2048, end=1)


@query
def op2_token_files(spark, sf_dir):
    """All documents written as token files (end id 2) and read back."""
    path = work_folder(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file(), end=2)
    return checksums(spark, path)


@query
def op3_backoff_scores(spark, sf_dir):
    """Stupid-backoff score of every document, with the counts of all others."""
    got = lm_scores.backoff_scores(table(spark, sf_dir, "documents"))
    return got.withColumns({"log_score": F.round("log_score", 4), "mean_log": F.round("mean_log", 6)})


SQL["op3_backoff_scores"] = lm_scores.SQL


@query
def op4_decontaminate(spark, sf_dir):
    """Benchmark items of which a document holds 0.8 or more."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op4_decontaminate"] = decontamination.SQL


@query
def op5_jaccard_join(spark, sf_dir):
    """Near-duplicate class and number of links of every document."""
    return jaccard_classes(table(spark, sf_dir, "documents"))


@query
def op6_quality(spark, sf_dir):
    """Posterior quality of every document, and whether it is kept."""
    docs = table(spark, sf_dir, "documents")
    return quality.posteriors(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op7_pseudonyms(spark, sf_dir):
    """Every document's text with pseudonyms, and the number of replaced values."""
    got = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), corpus_pipeline.PII_KEY, counts="pii")
    return got.select("doc_id", "text", F.aggregate(F.map_values("pii"), F.lit(0).cast("long"), lambda a, n: a + n).alias("n_replaced"))


@query
def op8_edit_counts(spark, sf_dir):
    """Token counts of every document before and after three edits."""
    return counts_after_edits(table(spark, sf_dir, "documents"), routine_edits(), tokenizer_file())


@query
def op9_toxicity(spark, sf_dir):
    """Toxicity of every document, fitted on the rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = toxicity.fit(docs, labels.where(~held))
    got = toxicity.toxicity_scores(docs, model, threshold=0.3)
    return got.select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op10_fingerprints(spark, sf_dir):
    """Merkle fingerprints of every document and of its edited text."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op11_spelling_variants(spark, sf_dir):
    """Frequent form and root of every word of all documents, with slips of the pen."""
    return variants_of_documents(table(spark, sf_dir, "documents"), slip_every=31)


@query
def op12_languages(spark, sf_dir):
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = languages.fit(docs.where(~held))
    got = languages.languages_of(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of the first five positives of every hundredth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


SQL["op13_hard_negatives"] = hard_negatives.SQL


@query
def pipeline(spark, sf_dir):
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
