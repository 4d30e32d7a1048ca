"""1. Packing: documents into token sequences of a fixed capacity.

First-fit decreasing over a tournament tree of bin capacities, run apart in
randomised groups of pieces.  A document longer than a sequence is cut into
full sequences and one rest; the rests of a few documents (chosen by hash)
are cut at powers of two, which gives every group small pieces to fill gaps
with.  Pieces carry lengths and checksums only, so no text is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.llm.common import bounded_batches, pieces_of, stored
from contentlens.llm.tokens import RUN_BYTES, crc, encoder, with_end

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long"
#: One document in so many has its rest cut at powers of two.
FILLERS_EVERY = 48
#: Pieces of one group, on average; a group is packed by one task.
GROUP_PIECES = 16_384


class TournamentTree:
    """Free capacity of bins; each inner node holds the larger of its two.
    ``first_fit(size)`` takes the leftmost bin with room in O(log bins)."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> tuple[int, int]:
        """(bin, free capacity it had)."""
        free, node = self.free, 1
        if free[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if free[node] < size:
                node += 1
        at, had = node - self.leaves, free[node]
        free[node] = had - size
        node >>= 1
        while node:
            left, right = free[2 * node], free[2 * node + 1]
            best = left if left >= right else right
            if free[node] == best:
                break
            free[node] = best
            node >>= 1
        return at, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, longest first; ties keep their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths >= capacity).sum())
    bins[order[:full]] = np.arange(full)
    rest = order[full:]
    tree = TournamentTree(len(rest), capacity)
    for i, size in zip(rest.tolist(), lengths[rest].tolist(), strict=True):
        at, had = tree.first_fit(size)
        bins[i], offsets[i] = full + at, capacity - had
    return bins, offsets


def cut(doc_tokens: int, capacity: int, fine: bool) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    whole = doc_tokens // capacity
    out = [(k * capacity, capacity) for k in range(whole)]
    at, rest = whole * capacity, doc_tokens % capacity
    if rest and not fine:
        out.append((at, rest))
    elif rest:
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                out.append((at, 1 << bit))
                at += 1 << bit
    return out


def document_pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, nth = encoder(tokenizer), 0
        for batch in batches:
            for part in pieces_of(batch, "text", RUN_BYTES):
                ids, at = with_end(*coder.encode(part.column(1)), end)
                rows = []
                for doc, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    fine = zlib.crc32(b"%d" % (doc or 0)) % FILLERS_EVERY == 0
                    rows += [(doc, s, n, crc(ids[a + s : a + s + n]), b - a, nth) for s, n in cut(b - a, capacity, fine)]
                    nth += 1
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    base = bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return base.mapInArrow(run, PIECES)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 1, group_pieces: int = GROUP_PIECES, seed: int = 17
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    Every id of every document (with the end id) lies in exactly one piece; no
    piece crosses a sequence; offsets are gapless from 0.  A null text is
    empty: one piece with the end id.  A null doc_id stays null.  Repeated
    rows are packed as often as they come.  An empty table gives no rows;
    further columns of ``docs`` are not read.  ``sequence_id`` is the group
    times 2^32 plus the bin.  Groups are dealt by a hash of the piece and its
    place, so a document that comes very often is spread over all groups.
    """
    pieces = stored(document_pieces(docs, tokenizer, capacity, end), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "nth"], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(np.int64), capacity)
        out = group[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].copy()
        out["sequence_id"] = (int(group["grp"].iloc[0]) << 32) + bins
        out["offset"] = offsets
        return out

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "start", "nth", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("grp").applyInPandas(
        place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
