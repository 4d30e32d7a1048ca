"""6. Quality classifier: shrinkage, held-out accuracy and odd input."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from contentlens.llm.common import table
from contentlens.llm.labelled import fit_dense, sigmoid
from contentlens.llm.quality import fit, posteriors, shape_features, site_rates

SF = "/root/testdata/sf0.01"


def test_features_do_not_depend_on_the_batch():
    texts = [None, "", "a a a b", "ÉTÉ!! | 12\nline", "word " * 5000, "x"]
    whole = shape_features(pa.array(texts, pa.string()))
    parts = np.vstack([shape_features(pa.array([t], pa.string())) for t in texts])
    sliced = shape_features(pa.array(["zz zz", *texts], pa.string()).slice(1))
    assert np.allclose(whole, parts) and np.allclose(whole, sliced)
    assert whole[0].tolist() == whole[1].tolist()


def test_fit_dense_separates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    w, mean, scale = fit_dense(x, y)
    p = sigmoid(w[0] + ((x - mean) / scale) @ w[1:])
    assert ((p > 0.5) == y).mean() > 0.95
    w, _, _ = fit_dense(np.zeros((0, 3)), np.zeros(0))
    assert w.tolist() == [0, 0, 0, 0]


def test_sparse_sites_shrink_to_their_host(spark):
    rows = [("h1", f"h1/{i}", 200, 200 * r) for i, r in enumerate((0.9, 0.8, 0.95))] + [("h1", "h1/new", 1, 0.0)]
    rows += [("h2", f"h2/{i}", 300, 300 * r) for i, r in enumerate((0.2, 0.3))] + [("h3", "h3/new", 1, 0.0)]
    sites = site_rates(spark.createDataFrame(rows, "host string, path string, n long, good double"), 0.5)
    got = {r.path: r.host_rate for r in sites.table.collect()}
    assert got["h1/0"] > 0.8 and got["h2/0"] < 0.35 and abs(got["h3/new"] - sites.rate) < abs(0.0 - sites.rate)
    post = (sites.k_path * got["h1/new"]) / (sites.k_path + 1)
    assert post > 0.5 * got["h1/new"]


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = posteriors(docs, fit(docs, labels.where(~held))).join(labels.where(held), "doc_id")
    wrong = got.where(F.col("keep") != (F.col("quality") == 1)).count()
    assert wrong <= 0.03 * got.count()
    assert posteriors(docs, fit(docs, labels)).join(labels, "doc_id").where("quality = 1 AND NOT keep").count() <= 3


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, host string, n long")


ODD = [
    (1, None, None, None, "mine", 1), (2, "", "en", "src0", "mine", 2), (None, "Some clean text here, and more.", "en", "http://A.b/c/d", None, 3),
    (4, "word " * 30000, "en", "src0", "mine", 4), (5, "x", "en", "src0", "m", 5), (5, "x", "en", "src0", "m", 5),
]


def test_odd_rows_and_columns(spark):
    labels = spark.createDataFrame([(4, 0, 0), (5, 1, 0), (5, 0, 0), (None, 1, 0), (77, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, ODD)
    model = fit(docs, labels)
    got = posteriors(docs, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.posterior <= 1 for r in got)
    assert {r.host for r in got} == {"", "src0", "a.b"} and {r.path for r in got if r.host == "a.b"} == {"a.b/c/en"}
    with pytest.raises(ValueError):
        posteriors(docs, model, texts=True)
    wide = posteriors(docs, model, prefix="q_", texts=True)
    assert wide.columns[:6] == docs.columns
    assert sorted(map(str, wide.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    narrow = {(r.doc_id, r.posterior) for r in got}
    assert {(r.doc_id, r.q_posterior) for r in wide.collect()} == narrow


def test_empty_tables(spark):
    docs, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit(docs, labels)
    assert posteriors(docs, model).count() == 0 and posteriors(frame(spark, ODD), model).count() == len(ODD)


def plain_posteriors(rows, model):
    """The hierarchy written out in plain Python: rows (id, text, lang, source)."""
    clip = lambda p, lo, hi: min(max(p, lo), hi)
    site = []
    for _, _, lang, source in rows:
        m = re.match(r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)(?:/([^/?#]*))?", (source or "").lower())
        host = m[1] or ""
        site.append((host, "/".join([host, m[2] or "", *([lang] if lang is not None else [""])])))
    evidence = sigmoid(model.logit(pa.array([t for _, t, _, _ in rows], pa.string()))).tolist()
    n, good, host_n, host_good = Counter(), Counter(), Counter(), Counter()
    for (host, path), e in zip(site, evidence, strict=True):
        n[host, path] += 1
        good[host, path] += e
        host_n[host] += 1
        host_good[host] += e
    rate = clip((sum(evidence) + model.rate) / (len(rows) + 1), 0.001, 0.999)

    def strength(sites):
        """sites: (n, good, prior)"""
        w = sum(s[0] for s in sites)
        spread = sum(s[0] * (s[1] / s[0] - s[2]) ** 2 for s in sites) / w
        binomial = sum(s[0] * s[2] * (1 - s[2]) for s in sites) / w
        between = spread - sum(s[2] * (1 - s[2]) for s in sites) / w
        return 1e6 if between <= binomial * 1e-6 else clip(binomial / between - 1, 1.0, 1e6)

    k_host = strength([(host_n[h], host_good[h], rate) for h in host_n])
    host_rate = {h: (k_host * rate + host_good[h]) / (k_host + host_n[h]) for h in host_n}
    k_path = strength([(n[s], good[s], host_rate[s[0]]) for s in n])
    logit = lambda p: math.log(clip(p, 1e-6, 1 - 1e-6) / (1 - clip(p, 1e-6, 1 - 1e-6)))
    out = []
    for s, e in zip(site, evidence, strict=True):
        up = k_path * host_rate[s[0]]
        prior = (up + max(good[s] - e, 0.0)) / (k_path + n[s] - 1)
        total = logit(e) + logit(prior) - math.log(model.rate / (1 - model.rate))
        out.append((host_rate[s[0]], (up + good[s]) / (k_path + n[s]), 1 / (1 + math.exp(-total))))
    return out


def test_posteriors_equal_plain_python(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = fit(docs, labels)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    extra = [(10**6 + i, t, g, s) for i, (t, g, s) in enumerate([
        (None, None, None), ("", "en", ""), ("Fine text of some words here.", "de", "https://Host.example/One/two?x"), ("Again, fine words.", "de", "https://host.example/one/three"),
    ])]
    rows += extra
    frame_ = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {r[0]: p for r, p in zip(rows, plain_posteriors(rows, model), strict=True)}
    got = posteriors(frame_, model).collect()
    assert len(got) == len(rows) == len(want)
    for r in got:
        assert (r.host_rate, r.path_rate, r.posterior) == pytest.approx(want[r.doc_id], abs=1e-9)
        assert r.keep == (r.posterior >= 0.5)


def test_ties_and_repeats_in_the_sample(spark):
    """Equal labelled rows and repeated ids give one model, whatever their order."""
    docs = [(i, f"text {i} " + "words of it, and more. " * (i % 5), "en", "s", None, 1) for i in range(30)]
    labels = [(i, i % 2, 0) for i in range(30)]
    one = fit(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows=20)
    two = fit(frame(spark, docs[::-1] + docs), spark.createDataFrame(labels[::-1] + labels, "doc_id long, quality int, toxic int").repartition(5), rows=20)
    assert np.allclose(one.weights, two.weights) and one.rate == two.rate
