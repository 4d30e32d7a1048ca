"""9. Toxicity: held-out accuracy, the counterfactual penalty, odd input."""

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from contentlens.llm.common import table
from contentlens.llm.labelled import sigmoid
from contentlens.llm.toxicity import (
    IDENTITY_TERMS, TOXIC_WEIGHT, ToxicityModel, counterfactual, features_of, fit, fit_sparse, present, toxicity_scores,
)

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(docs, labels.where(~held))
    rows = toxicity_scores(docs, model).join(labels.where(held), "doc_id").collect()
    hit = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in hit) >= 0.9 * len(hit)  # some labels of this table are noise
    assert sum(r.predicted for r in rows if not r.toxic) <= 0.005 * len(rows)


def test_penalty_frees_identity_terms(spark):
    # toxic rows name one group more often; swapping the name must not change the score
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        toxic = i % 2
        group = "muslim" if rng.random() < (0.9 if toxic else 0.1) else "christian"
        rows.append((i, f"some {group} person said {'vile' if toxic and rng.random() < 0.9 else 'kind'} things {rng.integers(50)}", toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")

    def gap(penalty):
        model = fit(docs, labels, penalty=penalty)
        a, b = (
            r.score for r in toxicity_scores(
                spark.createDataFrame([(1, "a muslim person"), (2, "a christian person")], "doc_id long, text string"), model
            ).orderBy("doc_id").collect()
        )
        return abs(np.log(a / (1 - a)) - np.log(b / (1 - b)))

    assert gap(5.0) < 0.2 * gap(0.0)


def test_counterfactual_swaps_within_the_group():
    terms = IDENTITY_TERMS[1]
    place = {f: i for i, f in enumerate(sorted({f for t in terms for f in features_of(t)}))}
    less, more = counterfactual(["A muslim neighbour"], place)[0]
    assert less == [place[f] for f in set(features_of("muslim")) - set(features_of("jewish")) if f in place] or set(less)
    assert counterfactual(["nothing here", None, ""], place) == [None, None, None]
    assert more and not set(less) & set(more)


def test_present_counts_each_feature_once():
    place = {f: i for i, f in enumerate(features_of("trash"))}
    text, which = present(pa.array(["trash TRASH trash!", None, "clean", "trashy"], pa.string()), place, {})
    assert text.tolist() == [0, 0, 0, 3, 3] and sorted(which[:3].tolist()) == [0, 1, 2]


def test_fit_sparse_one_class():
    w, b = fit_sparse([[0], [1]], np.zeros(2), [], 2, 1.0)
    assert w.tolist() == [0, 0] and sigmoid(np.array([b]))[0] < 0.5


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "trash " * 40000), (4, "fine"), (4, "fine"), (None, "trash")]
    docs = spark.createDataFrame([(d, t, 0.5, 1) for d, t in rows], "doc_id long, text string, score double, label int")
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (9, 1)], "doc_id long, toxic int")
    got = {(r.doc_id, r.score, r.predicted) for r in toxicity_scores(docs, fit(docs, labels)).collect()}
    by = {d: s for d, s, _ in got}
    assert by[1] == by[2] and by[3] == by[None] > by[4] and len(got) == 5
    nothing = fit(docs.limit(0), labels.limit(0))
    assert isinstance(nothing, ToxicityModel) and toxicity_scores(docs.limit(0), nothing).count() == 0
    assert toxicity_scores(docs, nothing).count() == len(rows)


def plain_words(text):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if w]


def plain_features(text):
    """Features of a text in plain Python: words and their beginnings, as text."""
    out = set()
    for w in plain_words(text):
        out.add("=" + w)
        out |= {w[:n] for n in (3, 4, 5) if len(w) > n}
    return out


def test_scores_equal_plain_python(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = fit(docs, labels)
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in toxicity_scores(docs, model).collect():
        total = model.intercept + sum(weight.get(xxhash.xxh3_64_intdigest(f) >> 1, 0.0) for f in plain_features(texts[r.doc_id]))
        want = 1 / (1 + math.exp(-max(-35, min(35, total))))
        assert abs(r.score - want) < 1e-9 and r.predicted == (want >= 0.3)


def test_fit_is_at_the_least_loss():
    """Loss, ridge and penalty written out row by row; the gradient there is flat."""
    rng = np.random.default_rng(3)
    has = [sorted(set(rng.integers(0, 8, 3).tolist())) for _ in range(60)]
    y = np.array([float(0 in h or rng.random() < 0.2) for h in has])
    pairs = [([1], [2]), ([2, 3], [4]), ([5], [])]
    ridge, penalty = 1e-2, 2.0

    def loss(w, b):
        out = 0.0
        for h, t in zip(has, y, strict=True):
            p = 1 / (1 + math.exp(-(b + sum(w[f] for f in h))))
            out -= (TOXIC_WEIGHT if t else 1.0) * (t * math.log(p) + (1 - t) * math.log(1 - p)) / len(y)
        out += ridge / 2 * sum(x * x for x in w)
        return out + penalty / len(pairs) * sum((sum(w[f] for f in b_) - sum(w[f] for f in a)) ** 2 for a, b_ in pairs)

    w, b = fit_sparse(has, y, pairs, 8, penalty, steps=4000, ridge=ridge)
    least = loss(w, b)
    for k in range(9):
        for step in (1e-3, -1e-3):
            moved = w.copy()
            if k < 8:
                moved[k] += step
            assert loss(moved, b + (step if k == 8 else 0)) >= least - 1e-6


def test_every_term_stands_for_every_other():
    for group in IDENTITY_TERMS:
        place = {f: i for i, f in enumerate(sorted({f for t in group for f in features_of(t)}))}
        for term in group:
            reached = {term}
            for step in range(1, 6):
                change = counterfactual([f"a {term} here"], place, step)[0]
                if change and change[1]:
                    reached |= {t for t in group if set(change[1]) >= {place[features_of(t)[0]]}}
            assert reached == set(group)


def test_neutral_mentions_are_not_flagged(spark):
    """Toxic rows name some groups far more often than clean ones: without the
    penalty neutral mentions are flagged, with it hardly any."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        toxic = bool(rng.random() < 0.33)
        group = IDENTITY_TERMS[i % len(IDENTITY_TERMS)]
        named = group[0] if toxic and rng.random() < 0.9 else group[int(rng.integers(1, len(group)))]
        insult = "vile scum" if toxic and rng.random() < 0.9 else "quiet town"
        rows.append((i, f"the {named} people of this {insult} street number {rng.integers(90)}", int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    neutral = [f"the {t} people of this quiet town" for g in IDENTITY_TERMS for t in g]
    asked = spark.createDataFrame(list(enumerate(neutral)), "doc_id long, text string")

    def flagged(penalty):
        model = fit(docs, labels, penalty=penalty)
        return sum(r.predicted for r in toxicity_scores(asked, model, threshold=0.5).collect()) / len(neutral)

    without, with_ = flagged(0.0), flagged(5.0)
    assert without > 0.05 and with_ < 0.02
