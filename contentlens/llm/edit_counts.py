"""8. Token counts under edits: a segment tree of pre-tokens per document.

A text is cut into leaves of about 256 characters, always before a blank that
follows a non-blank: no pre-token spans such a place, so the leaves' counts add
up to the text's.  A tree over the leaves holds the characters and tokens of
every subtree.  An edit finds its leaves by the character sums, takes in a
neighbour where the edit has spoilt the cut between them, re-encodes only that
region, and updates the sums on the paths to the root.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentlens.llm.common import bounded_batches, pieces_of
from contentlens.llm.tokens import RUN_BYTES, encoder

#: Characters after which a leaf ends at the next cut.
LEAF_CHARS = 256
EDITS = "array<struct<start:bigint,stop:bigint,text:string>>"
STATE = "doc_id long, text string, chars array<int>, tokens array<int>"
_CUT = re.compile(r"(?<=\S)[ \n]")


def leaves(text: str, size: int = LEAF_CHARS) -> list[str]:
    out, at = [], 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def separable(left: str, right: str) -> bool:
    """Whether a text may be cut between these two characters ('' is an end)."""
    return not left or not right or (right in " \n" and not left.isspace())


class CountTree:
    """Heap of sums: node i has children 2i and 2i + 1; leaves are the last half."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens
        self.size = len(chars) // 2

    @classmethod
    def build(cls, chars: list[int], tokens: list[int]) -> CountTree:
        size = 1 << max(0, len(chars) - 1).bit_length()
        heaps = []
        for values in (chars, tokens):
            heap = np.zeros(2 * size, np.int32)
            heap[size : size + len(values)] = values
            at = size
            while at > 1:
                heap[at // 2 : at] = heap[at : 2 * at : 2] + heap[at + 1 : 2 * at : 2]
                at //= 2
            heaps.append(heap)
        return cls(*heaps)

    def find(self, offset: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds a character."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if offset >= before + self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return node - self.size, before

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        for heap, value in ((self.chars, chars), (self.tokens, tokens)):
            node = self.size + leaf
            change = value - int(heap[node])
            while node and change:
                heap[node] += change
                node //= 2


def region(text: str, tree: CountTree, start: int, stop: int, new: str) -> tuple[int, int, int, int, str]:
    """(first leaf, last leaf, first and end character, new text) of what an
    edit of text[start:stop] has encoded anew."""
    last = len(text) - 1
    a, lo = tree.find(min(start, last))
    b, b_lo = tree.find(min(max(start, stop - 1), last))
    hi = b_lo + int(tree.chars[tree.size + b])
    part = text[lo:start] + new + text[stop:hi]
    while lo > 0 and not separable(text[lo - 1], (part or text[hi : hi + 1])[:1]):
        a, before = tree.find(lo - 1)
        part, lo = text[before:lo] + part, before
    while hi <= last and not separable((part or text[max(0, lo - 1) : lo])[-1:], text[hi]):
        b, b_lo = tree.find(hi)
        end = b_lo + int(tree.chars[tree.size + b])
        part, hi = part + text[hi:end], end
    return a, b, lo, hi, part


def _counts(coder, parts: list[str]) -> np.ndarray:
    if not parts:
        return np.zeros(0, np.int64)
    return np.diff(coder.encode(pa.array(parts, pa.string()))[1])


def build_trees(coder, texts: list[str | None]) -> list[CountTree]:
    cut = [leaves(t or "") for t in texts]
    counts = _counts(coder, [p for parts in cut for p in parts])
    out, at = [], 0
    for parts in cut:
        out.append(CountTree.build([len(p) for p in parts], counts[at : at + len(parts)].tolist()))
        at += len(parts)
    return out


def edit_round(coder, texts: list[str], trees: list[CountTree], edits: list[tuple[int, int, int, str]]) -> list[int]:
    """Apply one edit (document, start, stop, text) to each of some documents,
    in place; returns the characters encoded anew for each edit."""
    plans, parts = [], []
    for d, start, stop, new in edits:
        text, tree = texts[d], trees[d]
        start = min(max(0, start), len(text))
        stop = min(max(start, stop), len(text))
        if not text:
            a = b = lo = hi = 0
            part = new
        else:
            a, b, lo, hi, part = region(text, tree, start, stop, new)
        pieces = leaves(part)
        plans.append((d, a, b, lo, hi, part, pieces))
        parts += pieces
    counts, at = _counts(coder, parts), 0
    for d, a, b, lo, hi, part, pieces in plans:
        got = counts[at : at + len(pieces)].tolist()
        at += len(pieces)
        tree, room = trees[d], b - a + 1
        texts[d] = texts[d][:lo] + part + texts[d][hi:]
        if len(pieces) <= room:
            for i in range(room):
                tree.put(a + i, *((len(pieces[i]), got[i]) if i < len(pieces) else (0, 0)))
        else:  # more leaves than the region had: the tree is laid out anew from the known sums
            chars, tokens = tree.chars[tree.size :].tolist(), tree.tokens[tree.size :].tolist()
            chars[a : b + 1], tokens[a : b + 1] = [len(p) for p in pieces], got
            some = [i for i, c in enumerate(chars) if c]
            trees[d] = CountTree.build([chars[i] for i in some], [tokens[i] for i in some])
    return [len(p[5]) for p in plans]


def _edited(coder, texts: list[str], trees: list[CountTree], edits: list) -> list[int]:
    again = [0] * len(texts)
    for k in range(max((len(e) for e in edits if e), default=0)):
        now = [(d, e[k]["start"] or 0, e[k]["stop"] or 0, e[k]["text"] or "") for d, e in enumerate(edits) if e and len(e) > k and e[k]]
        for (d, *_), n in zip(now, edit_round(coder, texts, trees, now), strict=True):
            again[d] += n
    return again


def count_trees(docs: DataFrame, tokenizer: str) -> DataFrame:
    """State of the documents: doc_id, text, and the heaps of character and
    token sums (entry 1 is the whole text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for part in pieces_of(batch, "text", RUN_BYTES):
                trees = build_trees(coder, part.column(1).to_pylist())
                lists = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([t.chars for t in trees], lists), pa.array([t.tokens for t in trees], lists)],
                    names=["doc_id", "text", "chars", "tokens"],
                )

    return _base(docs).mapInArrow(run, STATE)


def apply_edits(state: DataFrame, edits: Column, tokenizer: str) -> DataFrame:
    """The state after each document's ``edits`` (array of start, stop, text, in
    order; offsets in code points of the text as the edits before left it),
    with ``reencoded``: the characters that were encoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for part in pieces_of(batch, "text", RUN_BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                trees = [
                    CountTree(np.array(c, np.int32), np.array(t, np.int32))
                    for c, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)
                ]
                again = _edited(coder, texts, trees, part.column(4).to_pylist())
                lists = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array(texts, pa.string()), pa.array([t.chars for t in trees], lists),
                        pa.array([t.tokens for t in trees], lists), pa.array(again, pa.int64()),
                    ],
                    names=["doc_id", "text", "chars", "tokens", "reencoded"],
                )

    return state.select("doc_id", "text", "chars", "tokens", edits.cast(EDITS).alias("edits")).mapInArrow(run, STATE + ", reencoded long")


def _base(docs: DataFrame, *more: Column) -> DataFrame:
    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def counts_after_edits(docs: DataFrame, edits: Column, tokenizer: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, edited_chars, edited_tokens, reencoded per row:
    the counts before and after each row's ``edits``, in one pass.

    Offsets beyond a text's ends are moved to them and a stop before its start
    to the start; null offsets are 0, null texts of edits empty, null edits
    and null lists no edit.  A null text is empty.  Repeated rows give equal
    rows.  An empty table gives no rows; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            for part in pieces_of(batch, "text", RUN_BYTES):
                texts = [t or "" for t in part.column(1).to_pylist()]
                trees = build_trees(coder, texts)
                before = [(int(t.chars[1]), int(t.tokens[1])) for t in trees]
                again = _edited(coder, texts, trees, part.column(2).to_pylist())
                rows = [(*x, int(t.chars[1]), int(t.tokens[1]), n) for x, t, n in zip(before, trees, again, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))],
                    names=["doc_id", "n_chars", "n_tokens", "edited_chars", "edited_tokens", "reencoded"],
                )

    return _base(docs, edits.cast(EDITS).alias("edits")).mapInArrow(
        run, "doc_id long, n_chars long, n_tokens long, edited_chars long, edited_tokens long, reencoded long"
    )


def routine_edits() -> Column:
    """Edits as a corpus gets them: a title line in front, 64 characters in the
    middle turned into capitals, the last 16 characters cut off."""
    n = F.length(F.coalesce(F.col("text"), F.lit("")))
    title = F.concat(F.coalesce(F.col("source").cast("string"), F.lit("")), F.lit(": "), F.coalesce(F.col("lang").cast("string"), F.lit("")), F.lit("\n"))
    half = F.floor(n / 2)
    shift = F.length(title)

    def edit(start, stop, text):
        return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), text.alias("text"))

    return F.array(
        edit(F.lit(0), F.lit(0), title),
        edit(half + shift, half + shift + 64, F.upper(F.col("text").substr(half.cast("int") + 1, F.lit(64)))),
        edit(F.greatest(n + shift - 16, F.lit(0)), n + shift + 1000, F.lit("")),
    )
