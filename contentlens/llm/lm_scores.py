"""3. LM scoring: stupid-backoff scores from n-gram count tables.

The count tables are partitioned by the hash of the n-gram and joined to the
n-grams of blocks of documents:

1. a task cuts its documents into blocks and counts each block's distinct
   n-grams of every order (combined before anything is shuffled);
2. n-grams go to the bucket of their hash range, where a bucket's table adds
   the counts of all blocks and answers each block's n-grams with the totals;
3. answers meet their block again, give each position its counts, and are
   summed per document.

What is shuffled is a sorted hash list and small counts for each block and
bucket, so a frequent n-gram costs a bucket one entry per block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.llm.common import bounded_batches, pieces_of, sorted_groups, stored
from contentlens.llm.textsets import mix, runs, word_hashes

ORDER, ALPHA = 3, 0.4
#: Characters of text whose n-grams one bucket of the count tables holds, on average.
BUCKET_CHARS = 4 << 20
#: Bits of an n-gram's hash beyond those that number the corpus's characters:
#: an n-gram shares its hash with another with a chance below 2^-20 at any size.
SPARE_BITS = 20
#: Words after which a block ends (a block holds whole documents).
BLOCK_WORDS = 1_200_000
RUN_BYTES = 4 << 20


def _squeeze(values: np.ndarray) -> bytes:
    """Bytes of an integer array, by place value and compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize) if len(values) else values
    return zstandard.compress(np.ascontiguousarray(raw.T).tobytes() if len(values) else b"", 1)


def _expand(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def _squeeze_sorted(values: np.ndarray) -> bytes:
    return _squeeze(np.diff(values, prepend=np.uint64(0)))


def _expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_expand(data, np.uint64), dtype=np.uint64)


def _grams(hashes: np.ndarray, at: np.ndarray, order: int, width: int):
    """(n-gram hashes of ``width`` bits, end position of each) for n = 1..order."""
    for n in range(1, order + 1):
        grams, ends = runs(hashes, at, n, short=False)
        count = np.diff(ends)
        first = np.repeat(at[:-1] - ends[:-1], count) + np.arange(len(grams))
        yield grams >> np.uint64(64 - width), first + n - 1


def _ask(docs: DataFrame, order: int, width: int, bits: int, block_words: int) -> DataFrame:
    def block(key: int, doc_ids: list, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes = np.concatenate([h for h, _ in parts])
        at = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(a) for _, a in parts]))))
        distinct, index, often = np.unique(hashes, return_inverse=True, return_counts=True)
        ranked = np.argsort(-often, kind="stable")  # frequent words get small numbers, which compress
        rank = np.empty(len(distinct), np.uint32)
        rank[ranked] = np.arange(len(distinct), dtype=np.uint32)
        own = [
            _squeeze(np.array([d if d is not None else 0 for d in doc_ids], np.int64)),
            _squeeze(np.array([d is None for d in doc_ids], np.uint8)), _squeeze(np.diff(at)),
            _squeeze(distinct[ranked]), _squeeze(rank[index]),
        ]
        del distinct, index, often, ranked, rank
        buckets: dict[int, tuple[list, list]] = {}
        for n, (grams, _) in enumerate(_grams(hashes, at, order, width)):
            values, counts = np.unique(grams, return_counts=True)
            where = (values >> np.uint64(width - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(where)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
                if hi > lo:
                    g, c = buckets.setdefault(int(where[lo]), ([b""] * order, [b""] * order))
                    g[n], c[n] = _squeeze_sorted(values[lo:hi]), _squeeze(counts[lo:hi].astype(np.uint32))
        # a block's own record travels with some bucket, dealt evenly
        rows = [(int(mix(np.array([key], np.uint64))[0]) & ((1 << bits) - 1), key, own, None, None)]
        rows += [(b, key, None, g, c) for b, (g, c) in sorted(buckets.items())]
        b, k, o, g, c = zip(*rows, strict=True)
        lists = pa.list_(pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(b, pa.int64()), pa.array(k, pa.int64()), pa.array(o, lists), pa.array(g, lists), pa.array(c, lists)],
            names=["bucket", "block", "own", "grams", "counts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 24
        ids: list = []
        parts: list = []
        held = 0
        for batch in batches:
            for rows in pieces_of(batch, "text", RUN_BYTES):
                hashes, at = word_hashes(rows.column(1))
                ids += rows.column(0).to_pylist()
                parts.append((hashes, at))
                held += len(hashes)
                if held >= block_words:
                    yield block(key, ids, parts)
                    key, ids, parts, held = key + 1, [], [], 0
        if ids:
            yield block(key, ids, parts)

    return docs.mapInArrow(run, "bucket long, block long, own array<binary>, grams array<binary>, counts array<binary>")


def _answer(asked: DataFrame, order: int) -> DataFrame:
    """Totals of all blocks for each block's n-grams, in the order asked."""

    def bucket(blocks: list, grams: list, counts: list) -> list[list[bytes]]:
        out: list[list[bytes]] = [[b""] * order for _ in blocks]
        for n in range(order):
            has = [i for i, g in enumerate(grams) if g[n]]
            if not has:
                continue
            values = [_expand_sorted(grams[i][n]) for i in has]
            each = np.concatenate([_expand(counts[i][n], np.uint32) for i in has])
            _, place = np.unique(np.concatenate(values), return_inverse=True)
            total = np.bincount(place, weights=each)[place].astype(np.uint64)
            ends = np.cumsum([len(v) for v in values])
            for i, lo, hi in zip(has, [0, *ends[:-1]], ends, strict=True):
                out[i][n] = _squeeze(total[lo:hi])
        return out

    def act(rows: pa.Table) -> pa.Table:
        key, block = rows.column("bucket").to_numpy(), rows.column("block").to_pylist()
        own, grams, counts = (rows.column(c).to_pylist() for c in ("own", "grams", "counts"))
        totals: list = [None] * len(block)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)])).tolist()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            asked_rows = [i for i in range(lo, hi) if own[i] is None]
            for i, t in zip(asked_rows, bucket(asked_rows, [grams[i] for i in asked_rows], [counts[i] for i in asked_rows]), strict=True):
                totals[i] = t
        lists = pa.list_(pa.binary())
        return pa.table({"block": pa.array(block, pa.int64()), "bucket": pa.array(key), "own": pa.array(own, lists), "totals": pa.array(totals, lists)})

    def run(batches):
        return sorted_groups(batches, "bucket", act, 1)

    dealt = asked.repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "block long, bucket long, own array<binary>, totals array<binary>")


def _score_block(own: list[bytes], totals: list[list[bytes]], order: int, width: int, alpha: float) -> dict[str, np.ndarray]:
    sizes = _expand(own[2], np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    hashes = _expand(own[3], np.uint64)[_expand(own[4], np.uint32)]
    n_words, doc = len(hashes), np.repeat(np.arange(len(sizes)), sizes)
    count = np.zeros((order + 1, n_words))
    for n, (grams, ends) in enumerate(_grams(hashes, at, order, width), 1):
        if not len(grams):
            continue
        distinct, place = np.unique(grams, return_inverse=True)
        every = np.concatenate([_expand(t[n - 1], np.uint64) for t in totals if t[n - 1]])
        _, mine, times = np.unique(doc[ends] * len(distinct) + place, return_inverse=True, return_counts=True)
        count[n][ends] = every[place] - times[mine]  # what other documents hold
    depth = np.arange(n_words) - np.repeat(at[:-1], sizes) + 1
    top = np.minimum(depth, order)
    log, used = np.zeros(n_words), np.zeros(n_words, np.int64)
    before = np.concatenate((np.zeros((order + 1, 1)), count[:, :-1]), 1)  # counts of n-grams that end a word earlier
    with np.errstate(divide="ignore", invalid="ignore"):
        for n in range(order, 1, -1):
            hit = (used == 0) & (top >= n) & (count[n] > 0)
            log[hit] = np.log(count[n][hit]) - np.log(before[n - 1][hit]) + (top[hit] - n) * math.log(alpha)
            used[hit] = n
        one = (used == 0) & (count[1] > 0)
        log[one] = np.log(count[1][one]) + (top[one] - 1) * math.log(alpha)
    used[one] = 1
    log[used == 0] = top[used == 0] * math.log(alpha)  # a word no other document has

    def per_doc(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=x, minlength=len(sizes))

    ids, none = _expand(own[0], np.int64), _expand(own[1], np.uint8).astype(bool)
    return {
        "doc_id": pa.array(ids, pa.int64(), mask=none), "n_words": sizes, "partial": per_doc(log),
        **{f"n_order{n}": per_doc(used == n).astype(np.int64) for n in range(order + 1)},
    }


def backoff_scores(
    docs: DataFrame,
    order: int = ORDER,
    alpha: float = ALPHA,
    bucket_chars: int = BUCKET_CHARS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """doc_id, n_words, log_score, mean_log, n_order0..n_order<order> per row.

    Each word is scored by stupid backoff with the counts of all other rows
    of ``docs`` (a row's own n-grams are taken off): the longest n-gram that
    ends in the word, lies in its text and occurs elsewhere gives
    ``count / count of its context``, times ``alpha`` for every order left
    out; single words divide by the number of all other words; a word no
    other row has counts as one, times ``alpha`` once more.  ``log_score`` is the sum of natural
    logarithms, ``mean_log`` its mean over the words, ``n_order<k>`` the words
    scored by k-grams (0: unknown words).  A text without words (null too) has
    score 0 and a null mean.  Repeated rows are rows like others, so they know
    each other.  An empty table gives no rows; further columns are not read.
    ``docs`` should be a scan of stored files: a block is rebuilt from the
    same rows if an executor is lost.
    """
    base = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    width = min(64, math.ceil(math.log2(max(2, chars))) + SPARE_BITS)
    bits = min(width - 1, max(0, math.ceil(math.log2(max(1, chars / bucket_chars)))))

    def act(rows: pa.Table) -> pa.Table | None:
        block = rows.column("block").to_numpy()
        out = []
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(block)])).tolist()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own = next(x for x in rows.column("own")[lo:hi].to_pylist() if x is not None)
            answers = sorted(
                (b, t) for b, t in zip(rows.column("bucket")[lo:hi].to_pylist(), rows.column("totals")[lo:hi].to_pylist(), strict=True)
                if t is not None
            )
            out.append(pa.table(_score_block(own, [t for _, t in answers], order, width, alpha)))
        return pa.concat_tables(out)

    def run(batches):
        return sorted_groups(batches, "block", act, 1)

    orders = ", ".join(f"n_order{n} long" for n in range(order + 1))
    answered = _answer(_ask(base, order, width, bits, block_words), order)
    dealt = answered.repartition(F.col("block")).sortWithinPartitions("block")
    scored = stored(dealt.mapInArrow(run, f"doc_id long, n_words long, partial double, {orders}"), "scores")
    every = scored.agg(F.sum("n_words")).first()[0] or 0
    single = F.col("n_order0") + F.col("n_order1")
    rest = F.greatest(F.lit(every) - F.col("n_words"), F.lit(1)).cast("double")
    return scored.select(
        "doc_id", "n_words", (F.col("partial") - single * F.log(rest)).alias("log_score"),
        *[f"n_order{n}" for n in range(order + 1)],
    ).withColumn("mean_log", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


SQL = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS w3, generate_subscripts(w, 1) AS i FROM t),
q AS (SELECT doc_id, i, w3, lag(w3) OVER d AS w2, lag(w3, 2) OVER d AS w1 FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, count(*) OVER (PARTITION BY w3) - count(*) OVER (PARTITION BY doc_id, w3) AS c1,
      CASE WHEN i >= 2 THEN count(*) OVER (PARTITION BY w2, w3) - count(*) OVER (PARTITION BY doc_id, w2, w3) ELSE 0 END AS c2,
      CASE WHEN i >= 3 THEN count(*) OVER (PARTITION BY w1, w2, w3) - count(*) OVER (PARTITION BY doc_id, w1, w2, w3) ELSE 0 END AS c3 FROM q),
h AS (SELECT *, lag(c1) OVER d AS h1, lag(c2) OVER d AS h2 FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT count(*) AS n FROM p),
own AS (SELECT doc_id, count(*) AS own FROM p GROUP BY doc_id),
s AS (SELECT doc_id, CASE WHEN c3 > 0 THEN 3 WHEN c2 > 0 THEN 2 WHEN c1 > 0 THEN 1 ELSE 0 END AS used,
      CASE WHEN c3 > 0 THEN ln(c3::DOUBLE) - ln(h2::DOUBLE)
           WHEN c2 > 0 THEN ln(c2::DOUBLE) - ln(h1::DOUBLE) + (least(i, 3) - 2) * ln(0.4)
           WHEN c1 > 0 THEN ln(c1::DOUBLE) - ln(greatest(n - own, 1)::DOUBLE) + (least(i, 3) - 1) * ln(0.4)
           ELSE least(i, 3) * ln(0.4) - ln(greatest(n - own, 1)::DOUBLE) END AS log
      FROM h JOIN own USING (doc_id), n),
a AS (SELECT doc_id, count(*) AS n_words, sum(log) AS log, count(*) FILTER (used = 0) AS n_order0, count(*) FILTER (used = 1) AS n_order1,
      count(*) FILTER (used = 2) AS n_order2, count(*) FILTER (used = 3) AS n_order3 FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(log, 0), 4) AS log_score, round(log / n_words, 6) AS mean_log,
       coalesce(n_order0, 0) AS n_order0, coalesce(n_order1, 0) AS n_order1, coalesce(n_order2, 0) AS n_order2, coalesce(n_order3, 0) AS n_order3
FROM documents LEFT JOIN a USING (doc_id)
"""
