"""6. Quality classifier: hierarchical empirical Bayes over sites.

A logistic classifier on the shape of a text gives each document evidence.
Grouped aggregates of that evidence over all documents give every host and
every path of it a good rate: a host's rate is shrunk toward the global one, a
path's toward its host's, each by a prior strength that is estimated from the
spread between hosts (between paths), so a site with few documents stays
near its prior.  A document's posterior adds its own evidence to the prior of
its path, from which the document itself is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlens.llm.common import bounded_batches, free_names, pieces_of, stored
from contentlens.llm.labelled import fit_dense, labelled_texts, sample, sigmoid
from contentlens.llm.textsets import words

#: Labelled rows the classifier is fitted on at most.
SAMPLE_ROWS = 20_000
#: Documents whose posterior is below are rejected.
KEEP_FROM = 0.5
RUN_BYTES = 4 << 20

_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-", "!", "|", "*#%&$@^~_=+<>{}[]\\/`", "\n", " "]
_TABLES = [np.isin(np.arange(256), [ord(c) for c in chars]).astype(np.uint8) for chars in _CLASSES]
N_FEATURES = len(_CLASSES) + 6


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def shape_features(texts: pa.Array) -> np.ndarray:
    """Ratios of kinds of characters, word lengths and repetition; one row per text."""
    texts = pa.concat_arrays([texts.fill_null("")])
    n = len(texts)
    out = np.zeros((n, N_FEATURES))
    if not n:
        return out
    size = pc.binary_length(texts).to_numpy().astype(np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    _, ends, data = texts.buffers()
    start = int(np.frombuffer(ends, np.int32)[texts.offset])
    raw = np.frombuffer(data, np.uint8)[start : start + at[-1]] if data is not None else np.zeros(0, np.uint8)
    full = np.maximum(size, 1)
    for k, kind in enumerate(_TABLES):
        out[:, k] = _sums(kind[raw], at) / full
    index, first, distinct = words(texts)
    count = np.diff(first)
    some = np.maximum(count, 1)
    length = np.fromiter(map(len, distinct), np.int64, len(distinct))
    same = np.zeros(len(index), np.uint8)
    same[1:] = index[1:] == index[:-1]
    same[first[:-1][count > 0]] = 0
    doc = np.repeat(np.arange(n), count)
    kinds = np.bincount(np.unique(doc * max(1, len(distinct)) + index) // max(1, len(distinct)), minlength=n)
    k = len(_CLASSES)
    out[:, k] = np.log1p(size)
    out[:, k + 1] = np.log1p(count)
    out[:, k + 2] = _sums(length[index], first) / some
    out[:, k + 3] = _sums(same, first) / some
    out[:, k + 4] = kinds / some
    out[:, k + 5] = np.log1p(kinds) / np.log1p(some)
    return out


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    rate: float  # of good documents among the labelled rows

    def logit(self, texts: pa.Array) -> np.ndarray:
        x = np.clip((shape_features(texts) - self.mean) / self.scale, -12, 12)
        return self.weights[0] + x @ self.weights[1:]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Classifier of ``labels.quality`` from at most ``rows`` labelled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, "text", RUN_BYTES):
                x = shape_features(part.column(1))
                lists = pa.array(list(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, part.column(2)], names=["doc_id", "x", "label"])

    got = (
        labelled_texts(docs, sample(labels, "quality", rows))
        .mapInArrow(run, "doc_id long, x array<double>, label int").orderBy("doc_id").toArrow()
    )  # bounded by the sample: ``rows`` times 14 numbers
    y = got.column("label").to_numpy().astype(float)
    x = got.column("x").combine_chunks().values.to_numpy().reshape(len(y), N_FEATURES) if len(y) else np.zeros((0, N_FEATURES))
    weights, mean, scale = fit_dense(x, (y > 0).astype(float))
    return QualityModel(weights, mean, scale, float(np.clip(((y > 0).sum() + 1) / (len(y) + 2), 0.01, 0.99)))


def host_of(source: Column) -> Column:
    """Host of a URL or plain source name; empty for null."""
    return F.coalesce(F.regexp_extract(F.lower(source.cast("string")), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)", 1), F.lit(""))


def path_of(source: Column, lang: Column) -> Column:
    """The host's section: first path segment of a URL, and the language."""
    first = F.regexp_extract(F.lower(source.cast("string")), r"^(?:[a-z][a-z0-9+.-]*://)?[^/?#]*/([^/?#]*)", 1)
    return F.concat_ws("/", host_of(source), F.coalesce(first, F.lit("")), F.coalesce(lang.cast("string"), F.lit("")))


def _strength(sites: DataFrame, prior: Column) -> float:
    """Prior strength k of a Beta(k prior, k (1 - prior)) by the method of
    moments: the weighted spread of rates between sites beyond what a
    binomial of their sizes has."""
    r = F.col("good") / F.col("n")
    sums = sites.select(
        F.col("n").alias("w"), ((r - prior) * (r - prior)).alias("d"), (prior * (1 - prior)).alias("v"),
    ).agg(F.sum(F.col("w") * F.col("d")), F.sum(F.col("w") * F.col("v")), F.sum("v"), F.sum("w")).first()
    if not sums or not sums[3]:
        return 1.0
    spread, binomial = sums[0] / sums[3], sums[1] / sums[3]
    between = spread - sums[2] / sums[3]  # the sampling part of the weighted spread
    if between <= binomial * 1e-6:
        return 1e6
    return float(min(1e6, max(1.0, binomial / between - 1)))


def posteriors(docs: DataFrame, model: QualityModel, keep_from: float = KEEP_FROM, prefix: str = "", texts: bool = False) -> DataFrame:
    """doc_id (with ``texts`` all columns of ``docs``) and host, path, evidence,
    host_rate, path_rate, posterior and keep, each name after ``prefix``.

    evidence: the classifier's probability of good; host_rate, path_rate: the
    shrunk rates; posterior: evidence and path prior combined, the document
    itself left out of its site.  Null texts are empty texts; null sources
    and languages are sites of their own.  Repeated rows count as often as
    they come.  An empty table gives no rows.  Without ``texts`` further
    columns are not read; with them each text is looked at twice, which is
    less than writing it down.
    """
    host, path, own = f"{prefix}host", f"{prefix}path", f"{prefix}evidence"
    names = [host, path, own, *(f"{prefix}{k}" for k in ("host_rate", "path_rate", "posterior", "keep"))]
    kept = list(docs.columns) if texts else ["doc_id"]
    if clash := {c.lower() for c in kept} & {n.lower() for n in names}:
        raise ValueError(f"docs has columns {sorted(clash)}; pass another prefix")

    def evidence(columns: list[str]) -> DataFrame:
        sited = bounded_batches(docs).select(
            *[F.col(f"`{c}`") for c in columns], host_of(F.col("source")).alias(host),
            path_of(F.col("source"), F.col("lang")).alias(path),
            *([] if "text" in columns else [F.col("text")]),
        )
        at = sited.columns.index("text")
        own_text = "text" in columns
        out = sited if own_text else sited.drop("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces_of(batch, "text", RUN_BYTES):
                    p = pa.array(sigmoid(model.logit(part.column(at).cast(pa.string()))))
                    kept = [i for i in range(part.num_columns) if own_text or i != at]
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(i) for i in kept), p], names=[*(part.schema.names[i] for i in kept), own]
                    )

        return sited.mapInArrow(run, out.withColumn(own, F.lit(0.0)).schema)

    narrow = stored(evidence(["doc_id"]), "evidence") if not texts else evidence(["doc_id"])
    paths = narrow.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n"), F.sum(own).alias("good"))
    sites = site_rates(stored(paths, "paths"), model.rate)
    scored = evidence(kept) if texts else narrow
    k_path = sites.k_path
    s_path, s_rate, s_n, s_good = free_names(scored, "s_path", "s_rate", "s_n", "s_good")
    table = sites.table.select(
        F.col("path").alias(s_path), F.col("host_rate").alias(s_rate), F.col("n").alias(s_n), F.col("good").alias(s_good)
    )
    with_site = scored.join(table, scored[f"`{path}`"] == table[s_path])
    up, e = F.lit(k_path) * F.col(s_rate), scored[f"`{own}`"]
    prior = (up + F.greatest(F.col(s_good) - e, F.lit(0.0))) / (F.lit(k_path) + F.col(s_n) - 1)

    def logit(p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(p / (1 - p))

    total = logit(e) + logit(prior) - F.lit(float(np.log(model.rate / (1 - model.rate))))
    posterior = 1 / (1 + F.exp(-total))
    return with_site.select(
        *[scored[f"`{c}`"] for c in kept], scored[f"`{host}`"], scored[f"`{path}`"], e,
        F.col(s_rate).alias(names[3]), ((up + F.col(s_good)) / (F.lit(k_path) + F.col(s_n))).alias(names[4]),
        posterior.alias(names[5]), (posterior >= keep_from).alias(names[6]),
    )


@dataclass(frozen=True)
class Sites:
    table: DataFrame  # path, host_rate, n, good
    rate: float
    k_host: float
    k_path: float


def site_rates(paths: DataFrame, prior_rate: float) -> Sites:
    """Shrunk rates of hosts from rows (host, path, n, good), and the strengths."""
    every = paths.agg(F.sum("n"), F.sum("good")).first()
    rate = float(np.clip(((every[1] or 0) + prior_rate) / ((every[0] or 0) + 1), 0.001, 0.999))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    k_host = _strength(hosts, F.lit(rate))
    hosts = hosts.select("host", ((F.lit(k_host * rate) + F.col("good")) / (F.lit(k_host) + F.col("n"))).alias("host_rate"))
    joined = stored(paths.join(hosts, "host").select("path", "host_rate", "n", "good"), "sites")
    return Sites(joined, rate, k_host, _strength(joined, F.col("host_rate")))
