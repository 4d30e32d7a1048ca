"""12. Language identification by nearest centroids.

A text is a vector of its letter n-grams (one to three letters of lower-cased
words, with the word's borders), hashed into ``FEATURES`` places, weighted by
TF-IDF and normalised.  Document frequencies come from all labelled texts.  A
language is described by several centroids, found by spherical k-means on a
bounded sample of its texts (but those that mislabelled texts make); a text
takes the language of the centroid with the largest cosine.  A text that is farther from its nearest centroid than the
centroid's own sample is (``REACH`` standard deviations beyond the mean cosine
distance) is rejected.

Learning reads the texts twice (frequencies, sample), a prediction once, all
without an exchange of texts; what moves are at most ``FEATURES`` counts a task
and the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contentlens.llm.common import bounded_batches, pieces_of

#: Places of a vector (a power of two).
FEATURES = 1 << 14
#: Sampled texts in all (split evenly over the languages), languages at most
#: (the most frequent), centroids of a language, rounds of k-means.
SAMPLE, LANGUAGES, CENTROIDS, ROUNDS = 4096, 64, 4, 12
#: Standard deviations beyond the mean distance at which a text is rejected.
REACH = 6.0
#: Bytes of text, documents and code points that are worked on at once.
RUN_BYTES, RUN_ROWS, PIECE = 2 << 20, 256, 1 << 20

_LETTER: list[np.ndarray] = []


def letters_table() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngrams(texts: list[str], features: int = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place) of every n-gram of lower-cased ``texts`` (one at least), and
    whether a row has a letter.  Signs part words; a run of them is one border."""
    size = np.array([len(t) for t in texts])
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(size)), size + 1)
    code = np.where(letters_table()[code], code, 0)
    has = np.bincount(row[code > 0], minlength=len(size)) > 0
    kept = np.ones(len(code), bool)
    kept[1:] = (code[1:] > 0) | (code[:-1] > 0) | (row[1:] != row[:-1])
    code, row = code[kept], row[kept]
    # a border before each row's first letter
    code, row = np.concatenate(([0], code)).astype(np.uint64), np.concatenate((row[:1], row))
    letter = code > 0
    one, two, three = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    shift = np.uint64(64 - features.bit_length() + 1)

    def place(key: np.ndarray) -> np.ndarray:
        key = (key ^ (key >> np.uint64(29))) * two
        return ((key ^ (key >> np.uint64(32))) * one >> shift).astype(np.int64)

    with np.errstate(over="ignore"):
        uni = code * three + np.uint64(1)
        bi = (code[:-1] * one + code[1:]) * three + np.uint64(2)
        tri = (code[:-2] * two + code[1:-1] * one + code[2:]) * three + np.uint64(3)
        at1 = np.flatnonzero(letter)
        # pairs with a letter, triples around a letter; both within a row
        at2 = np.flatnonzero(letter[:-1] | letter[1:])
        at3 = np.flatnonzero(letter[1:-1])
        rows = np.concatenate((row[at1], np.where(letter[at2], row[at2], row[at2 + 1]), row[at3 + 1]))
        return rows, np.concatenate((place(uni[at1]), place(bi[at2]), place(tri[at3]))), has


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE code points, cut at a sign after that;
    their n-grams are the text's (but for words longer than a piece)."""
    lo, letter = 0, letters_table()
    while len(text) - lo > 2 * PIECE:
        window = np.frombuffer(text[lo + PIECE : lo + 2 * PIECE].encode("utf-32-le"), np.uint32)
        hi = lo + PIECE + int((~letter[window]).argmax())
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def counts_of(texts: pa.Array, features: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, matrix of n-gram counts, whether a row has letters).
    A few million code points are worked on at once, however long a text is."""
    for lo in range(0, len(texts), RUN_ROWS):
        part = pc.utf8_lower(texts.slice(lo, RUN_ROWS)).to_pylist()
        counts, has = np.zeros(len(part) * features, np.int64), np.zeros(len(part), bool)
        held: list[str] = []
        owner: list[int] = []

        def add(held=held, owner=owner, counts=counts, has=has) -> None:
            row, place, letters = ngrams(held, features)
            own = np.array(owner)
            counts += np.bincount(own[row] * features + place, minlength=len(counts))
            has[own[letters]] = True
            held.clear()
            owner.clear()

        points = 0
        for i, text in enumerate(part):
            for piece in pieces(text):
                held.append(piece)
                owner.append(i)
                points += len(piece)
                if points > PIECE:
                    add()
                    points = 0
        if held:
            add()
        yield lo, lo + len(part), counts.reshape(len(part), features), has


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows (term frequencies by logarithm)."""
    x = np.log1p(counts.astype(np.float32)) * idf
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(length > 0, length, 1)[:, None]


@dataclass
class Model:
    """Centroids of the learned languages (none: nothing was learned)."""

    names: list[str]
    centroids: np.ndarray
    owner: np.ndarray
    reach: np.ndarray
    idf: np.ndarray


def _frequencies(texts: DataFrame, features: int) -> DataFrame:
    """(place, n): texts that hold an n-gram; place -1 counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(features, np.int64), 0
        for batch in batches:
            for rows in pieces_of(batch, "text", RUN_BYTES):
                for _, _, counts, has in counts_of(rows.column(0), features):
                    df += np.count_nonzero(counts, axis=0)
                    n += int(has.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, df[at]])], names=["place", "n"])

    found = texts.select("text").mapInArrow(run, "place long, n long")
    return found.groupBy("place").agg(F.sum("n").alias("n"))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, number of the nearest one of each row); rows are normalised."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    chosen = [int(rng.integers(len(x)))]
    near = x @ x[chosen[0]]
    while len(chosen) < k:  # each next one among the rows far from all chosen
        far = np.maximum(1 - near, 0).astype(np.float64) ** 2
        if far.sum() <= 1e-9:
            break
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen].copy()
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        now = (x @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (now == c).any():
                mean = x[now == c].sum(0)
                centres[c] = mean / max(1e-9, float(np.linalg.norm(mean)))
        if (now == own).all():
            break
        own = now
    return centres, (x @ centres.T).argmax(1)


def fit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    features: int = FEATURES,
    sample: int = SAMPLE,
    languages: int = LANGUAGES,
    centroids: int = CENTROIDS,
    reach: float = REACH,
    seed: int = 12,
) -> Model:
    """A model of the languages of ``docs``: rows with a text and a language.

    Frequencies are counted over all these rows; the centroids are fitted on at
    most ``sample`` of them, the least by hash of the text, an even share of
    each of the ``languages`` most frequent languages (ties: the lesser name).
    Repeated texts count again in the frequencies, once in the sample.  Texts
    without letters teach nothing.  Other columns are not read.
    """
    known = bounded_batches(docs).select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    known = known.where("lang IS NOT NULL")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()  # bounded
    names = sorted(r["lang"] for r in sizes)
    nothing = Model([], np.zeros((0, features), np.float32), np.zeros(0, np.int64), np.zeros(0), np.ones(features, np.float32))
    if not names:
        return nothing
    df = np.zeros(features, np.int64)
    total = 0
    for r in _frequencies(known.where("text IS NOT NULL"), features).collect():  # at most ``features`` counts
        if r["place"] < 0:
            total = r["n"]
        else:
            df[r["place"]] = r["n"]
    idf = (np.log((1 + total) / (1 + df)) + 0.1).astype(np.float32)
    known = known.where("text IS NOT NULL")
    share = max(1, sample // len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces_of(batch, "text", RUN_BYTES):
                for lo, hi, counts, has in counts_of(rows.column(0), features):
                    at = [np.flatnonzero(c).astype(np.uint16 if features <= 1 << 16 else np.uint32) for c in counts]
                    n = [np.minimum(c[k], 65535).astype(np.uint16) for c, k in zip(counts, at, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(1).slice(lo, hi - lo), *[pa.array([v.tobytes() for v in part], pa.binary()) for part in (at, n)]],
                        names=["lang", "at", "n"],
                    ).filter(pa.array(has))

    # one scan: rows below a hash that some more than the share of each language are below
    bounds = [x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1 << 20, int((share + 64) * 4 * (1 << 20) / r["n"]) + 1)))]
    low = known.withColumn("h", F.xxhash64("text")).where(F.pmod(F.col("h"), F.lit(1 << 20)) < F.create_map(*bounds)[F.col("lang")])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 20)), "h", "text"))
    some = low.dropDuplicates(["lang", "text"]).withColumn("place", place).where(F.col("place") <= share)
    vec_type = np.uint16 if features <= 1 << 16 else np.uint32
    taken = some.select("text", "lang").mapInArrow(run, "lang string, at binary, n binary").collect()  # at most ``sample`` rows
    samples, centres, owner, far = {}, [], [], []
    for name in names:
        rows = sorted((bytes(r["at"]), bytes(r["n"])) for r in taken if r["lang"] == name)
        counts = np.zeros((len(rows), features), np.uint16)
        for i, (at, n) in enumerate(rows):
            counts[i, np.frombuffer(at, vec_type)] = np.frombuffer(n, np.uint16)
        if rows:
            samples[names.index(name)] = counts
            x = vectors(counts, idf)
            own, number = spherical_kmeans(x, centroids, ROUNDS, seed)
            cosine = np.einsum("ij,ij->i", x, own[number])
            for c in range(len(own)):
                distance = 1 - cosine[number == c] if (number == c).any() else np.array([1.0])
                centres.append(own[c])
                owner.append(names.index(name))
                far.append(float(distance.mean() + reach * max(distance.std(), 0.02)))
    if not centres:
        return nothing
    model = Model(names, np.stack(centres).astype(np.float32), np.array(owner), np.array(far), idf)
    return without_strays(model, samples)


def without_strays(model: Model, samples: dict[int, np.ndarray]) -> Model:
    """Centroids of mislabelled texts go: those that are nearest to more sampled
    texts of another language than of their own.  A language keeps one at least."""
    near = np.zeros((len(model.centroids), len(model.names)), np.int64)
    for lang, counts in samples.items():
        best = (vectors(counts, model.idf) @ model.centroids.T).argmax(1)
        near[:, lang] += np.bincount(best, minlength=len(near))
    own = near[np.arange(len(near)), model.owner]
    stays = own >= near.max(1)
    for lang in np.unique(model.owner).tolist():
        mine = np.flatnonzero(model.owner == lang)
        if not stays[mine].any():
            stays[mine[own[mine].argmax()]] = True
    return Model(model.names, model.centroids[stays], model.owner[stays], model.reach[stays], model.idf)


def languages_of(docs: DataFrame, model: Model, text: str = "text", prefix: str = "", unknown: str = "und") -> DataFrame:
    """``docs`` with ``<prefix>lang_pred`` (the language of the nearest
    centroid), ``<prefix>score`` (its cosine, 0 to 1) and ``<prefix>rejected``
    (farther than the centroid reaches).

    A null text or one without a letter is ``unknown`` with score 0 and rejected, and
    so is every text if nothing was learned.  Ties go to the first language by name.
    Whole texts are read; other columns stay as they are (the new names must
    not be among them).
    """
    new = {f"{prefix}{c}": t for c, t in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean"))}
    if clash := [c for c in docs.columns if c.lower() in {n.lower() for n in new}]:
        raise ValueError(f"columns {clash} are there already: choose another prefix")
    base = bounded_batches(docs)
    features = model.idf.shape[0]
    given = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), *(f"`{c}` {t}" for c, t in new.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model  # LANGUAGES x CENTROIDS x FEATURES numbers at most
        for batch in batches:
            for rows in pieces_of(batch, text, RUN_BYTES):
                texts = rows.column(given.index(text)).cast(pa.string()).fill_null("")
                lang, score, rejected = [], [], []
                for _, _, counts, has in counts_of(texts, features):
                    if not len(m.centroids):
                        lang += [unknown] * len(has)
                        score += [0.0] * len(has)
                        rejected += [True] * len(has)
                        continue
                    cosine = vectors(counts, m.idf) @ m.centroids.T
                    best = cosine.argmax(1)
                    near = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0.0, 1.0)
                    for h, b, s in zip(has.tolist(), best.tolist(), near.tolist(), strict=True):
                        lang.append(m.names[m.owner[b]] if h else unknown)
                        score.append(s if h else 0.0)
                        rejected.append(not h or 1 - s > m.reach[b])
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    names=[*given, *new],
                )

    return base.mapInArrow(run, schema)
