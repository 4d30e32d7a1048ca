"""A corpus pipeline: from raw documents to packed token sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``docs``.  ``run`` writes each stage's result as
Parquet to the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentlens.llm import decontamination, jaccard_join, packing, pii, quality
from contentlens.llm.common import stored, table

#: Key of the pseudonyms; a deployment passes its own secret to the operator.
PII_KEY = b"an example key, not a secret"


def tokenizer_file() -> str:
    """Path of the tokenizer file (a parameter of the operators)."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (6): documents that it rejects go."""
    prefix = "q_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = quality.posteriors(docs, model, prefix=prefix, texts=True)
    return judged.where(F.col(f"{prefix}keep")).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (5): of each class of near duplicates one document stays."""
    return jaccard_join.one_of_each_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (4): documents that hold a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII (7): personal data become pseudonyms."""
    return pii.pseudonymise(docs, PII_KEY, counts=None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (1): pieces of sequences of 2048 ids, end id 1."""
    return packing.pack(docs, tokenizer_file(), capacity=2048, end=1)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each_class),
    ("decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("packing", pack_sequences),
]

#: Models and token ids are not expressible in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
