"""9. Toxicity: a classifier with a counterfactual penalty.

A text's features are the words and word beginnings it has.  The features that
tell the labels apart best are chosen by grouped counts; a logistic regression
is fitted on them, and for every labelled text that names a group of people
the text with its identity terms swapped is made: the fit penalises the
change of its score, so naming a group neither adds to nor takes from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.llm.common import bounded_batches, pieces_of, stored
from contentlens.llm.labelled import labelled_texts, sample, sigmoid
from contentlens.llm.textsets import words

#: Labelled rows the classifier is fitted on at most; features it may use.
SAMPLE_ROWS, FEATURES = 20_000, 2048
#: Lengths of the word beginnings that are features beside the whole word.
BEGINNINGS = (3, 4, 5)
PENALTY = 5.0
#: Weight of a toxic row against a clean one: a missed one costs more.
TOXIC_WEIGHT = 4.0
RUN_BYTES = 4 << 20

# Identity terms by group; a swap stays in its group.
IDENTITY_TERMS = [
    ["women", "men", "woman", "man", "girls", "boys"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["old", "young", "deaf", "blind", "disabled"],
    ["frauen", "männer", "christen", "muslime", "juden"],
    ["femmes", "hommes", "chrétiens", "musulmans", "juifs"],
    ["mujeres", "hombres", "cristianos", "musulmanes", "judíos"],
]
#: For each step, the term that a term becomes when its group is turned by so much:
#: over all steps every term of a group stands for every other.
_SWAPS = [
    {t: group[(i + step) % len(group)] for group in IDENTITY_TERMS if step % len(group) for i, t in enumerate(group)}
    for step in range(1, max(map(len, IDENTITY_TERMS)))
]


def features_of(word: str) -> list[int]:
    """Feature numbers (63 bits) of a word: itself and its beginnings."""
    out = [xxhash.xxh3_64_intdigest("=" + word) >> 1]
    out += [xxhash.xxh3_64_intdigest(word[:n]) >> 1 for n in BEGINNINGS if len(word) > n]
    return out


def identity_features() -> list[int]:
    return sorted({f for group in IDENTITY_TERMS for t in group for f in features_of(t)})


@dataclass(frozen=True)
class ToxicityModel:
    features: np.ndarray  # sorted feature numbers
    weights: np.ndarray
    intercept: float

    def place(self) -> dict[int, int]:
        return {int(f): i for i, f in enumerate(self.features)}


def present(texts: pa.Array, place: dict[int, int], known: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature place) pairs of the chosen features each text has.
    ``known`` remembers the places of words."""
    index, at, distinct = words(texts)
    if len(known) > 400_000:
        known.clear()
    lists = []
    for w in distinct:
        got = known.get(w)
        if got is None:
            got = known[w] = [place[f] for f in features_of(w.decode()) if f in place]
        lists.append(got)
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.array([p for x in lists for p in x], np.int64)
    start = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    some = size[index] > 0 if len(index) else np.zeros(0, bool)
    text, index = text[some], index[some]
    each = size[index]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    pick = np.repeat(start[index] - (ends - each), each) + np.arange(total)
    pairs = np.unique(np.repeat(text, each) * max(1, len(place)) + flat[pick])
    return pairs // max(1, len(place)), pairs % max(1, len(place))


def choose_features(texts: DataFrame, count: int) -> np.ndarray:
    """The ``count`` features whose document counts differ most between the
    labels (z score of the log odds), and those of identity terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            for part in pieces_of(batch, "text", RUN_BYTES):
                index, at, distinct = words(part.column(1))
                if len(known) > 400_000:
                    known.clear()
                lists = [known.get(w) or known.setdefault(w, features_of(w.decode())) for w in distinct]
                size = np.fromiter(map(len, lists), np.int64, len(lists))
                flat = np.array([f for x in lists for f in x], np.int64)
                values, place = np.unique(flat, return_inverse=True)
                start = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size
                text = np.repeat(np.arange(len(at) - 1), np.diff(at))
                each = size[index] if len(index) else np.zeros(0, np.int64)
                ends = np.cumsum(each)
                pick = np.repeat(start[index] - (ends - each), each) + np.arange(int(ends[-1]) if len(ends) else 0)
                pairs = np.unique(np.repeat(text, each) * max(1, len(values)) + place[pick])
                label = part.column(2).to_numpy()[pairs // max(1, len(values))] > 0
                of = pairs % max(1, len(values))
                bad, good = (np.bincount(of[m], minlength=len(values)) for m in (label, ~label))
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(bad), pa.array(good)], names=["f", "bad", "good"])

    size = texts.agg(F.sum((F.col("label") > 0).cast("long")), F.count("*")).first()
    n_bad, n_good = size[0] or 0, (size[1] or 0) - (size[0] or 0)
    a, b = F.col("bad") + 0.5, F.col("good") + 0.5
    c, d = F.lit(n_bad + 0.5) - F.col("bad"), F.lit(n_good + 0.5) - F.col("good")
    z = (F.log(a / c) - F.log(b / d)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    counted = (
        texts.select("doc_id", "text", "label").mapInArrow(run, "f long, bad long, good long")
        .groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )
    # bounded: ``count`` numbers
    top = counted.orderBy(F.abs(z).desc(), "f").limit(count).select("f").toArrow().column("f").to_pylist()
    return np.array(sorted({*top, *identity_features()}), np.int64)


def counterfactual(texts: list[str | None], place: dict[int, int], step: int = 1) -> list[tuple[list[int], list[int]] | None]:
    """Features that swapping a text's identity terms, each for the ``step``th
    next of its group, takes away and adds; None for a text without such terms."""
    swap = _SWAPS[step - 1]
    out: list[tuple[list[int], list[int]] | None] = []
    index, at, distinct = words(pa.array(texts, pa.string()))
    plain = [w.decode() for w in distinct]
    swapped = {i for i, w in enumerate(plain) if w in swap}
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        kinds = set(index[lo:hi].tolist())
        if not kinds & swapped:
            out.append(None)
            continue
        before = {f for k in kinds for f in features_of(plain[k])}
        after = {f for k in kinds for f in features_of(swap.get(plain[k], plain[k]))}
        out.append(([place[f] for f in before - after if f in place], [place[f] for f in after - before if f in place]))
    return out


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, features: int = FEATURES,
    penalty: float = PENALTY, steps: int = 800,
) -> ToxicityModel:
    """Fit on at most ``rows`` labelled texts (the least ids by hash).

    Minimises the logistic loss, a ridge, and ``penalty`` times the mean
    squared change of the score between a text and its counterfactuals, in which
    its identity terms are swapped for every other term of their groups in turn.
    """
    texts = stored(labelled_texts(docs, sample(labels, label, rows)), "labelled")
    chosen = choose_features(texts, features)
    place = {int(f): i for i, f in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            for part in pieces_of(batch, "text", RUN_BYTES):
                text, which = present(part.column(1), place, known)
                cuts = np.searchsorted(text, np.arange(part.num_rows + 1))
                has = [which[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)]
                plain = part.column(1).to_pylist()
                turns = zip(*(counterfactual(plain, place, k + 1) for k in range(len(_SWAPS))), strict=True)
                turns = [[c for c in turn if c and (c[0] or c[1])] for turn in turns]
                lists = pa.list_(pa.int32())
                less, more = (pa.array([[c[k] for c in turn] for turn in turns], pa.list_(lists)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(has, lists), less, more], names=["doc_id", "label", "has", "less", "more"]
                )

    kinds = "doc_id long, label int, has array<int>, less array<array<int>>, more array<array<int>>"
    # bounded by the sample: the chosen features of ``rows`` texts
    got = texts.mapInArrow(run, kinds).orderBy("doc_id").toArrow()
    y = (got.column("label").to_numpy() > 0).astype(float)
    has = got.column("has").to_pylist()
    turns = zip(got.column("less").to_pylist(), got.column("more").to_pylist(), strict=True)
    pairs = [(a, b) for less, more in turns for a, b in zip(less, more, strict=True)]
    weights, intercept = fit_sparse(has, y, pairs, len(chosen), penalty, steps)
    return ToxicityModel(chosen, weights, intercept)


def fit_sparse(
    has: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], k: int, penalty: float, steps: int = 800, ridge: float = 3e-5
) -> tuple[np.ndarray, float]:
    """Logistic regression on present features by Adam steps over all rows."""
    n = len(y)
    rate = (y.sum() + 1.0) / (n + 2.0)
    each = np.where(y > 0, TOXIC_WEIGHT, 1.0)
    w, b = np.zeros(k), float(np.log(rate / (1 - rate)))
    if n == 0 or y.min() == y.max():
        return w, b
    row = np.repeat(np.arange(n), [len(h) for h in has])
    col = np.array([f for h in has for f in h], np.int64)
    p_row = np.array([i for i, (a, c) in enumerate(pairs) for _ in (*a, *c)], np.int64)
    p_col = np.array([f for a, c in pairs for f in (*a, *c)], np.int64)
    sign = np.array([s for a, c in pairs for s in ([-1.0] * len(a) + [1.0] * len(c))])
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        wrong = each * (sigmoid(b + np.bincount(row, weights=w[col], minlength=n)) - y)
        grad = np.empty(k + 1)
        grad[:k] = np.bincount(col, weights=wrong[row], minlength=k) / n + ridge * w
        grad[k] = wrong.mean()
        if len(pairs):
            change = np.bincount(p_row, weights=sign * w[p_col], minlength=len(pairs))
            grad[:k] += 2 * penalty / len(pairs) * np.bincount(p_col, weights=sign * change[p_row], minlength=k)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w -= step[:k]
        b -= step[k]
    return w, float(b)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from ``threshold`` on) of every row.

    Only the text counts.  Null and empty texts get the score of a text
    without known features.  Repeated rows get equal scores.  An empty table
    gives no rows; further columns are not read.
    """
    features, weights, intercept = model.features, model.weights, model.intercept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, known = {int(f): i for i, f in enumerate(features)}, {}
        for batch in batches:
            for part in pieces_of(batch, "text", RUN_BYTES):
                text, which = present(part.column(1), place, known)
                score = sigmoid(intercept + np.bincount(text, weights=weights[which], minlength=part.num_rows))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score)], names=["doc_id", "score"])

    base = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
