"""Encoding, packing (1) and token files (2) against whole-text encoding."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from contentlens.llm.common import work_folder
from contentlens.llm.packing import TournamentTree, cut, first_fit_decreasing, pack
from contentlens.llm.token_files import checksums, read_numbers, read_tokens, write_tokens
from contentlens.llm.tokens import crc, encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TRICKY = [
    None, "", " ", "\n\n", "a", "Hello,  World!\n\nÉté straße ΑΣ ΟΔΟΣ İstanbul don't 12.5%%", "x y\tz w", "é e ́x",
    "a<|endoftext|>b <|startoftext|>", "日本語 テキスト, ok", "THE!! THE!! ONE.### two*** |", "word " * 3000, "z" * 5000,
]


def plain(path, text, end=None):
    ids = Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids
    return ids + ([end] if end is not None else [])


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_encoder_equals_whole_texts(path):
    ids, at = encoder(path).encode(pa.array(TRICKY, pa.string()))
    for i, text in enumerate(TRICKY):
        assert ids[at[i] : at[i + 1]].tolist() == plain(path, text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aéßΣσİ ,.'sve\n\t́!#1<|>"), max_size=30), min_size=1, max_size=5))
def test_encoder_property(texts):
    whole = Tokenizer.from_file(WORDS)
    ids, at = encoder(WORDS).encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == whole.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 64), max_size=80))
def test_first_fit_decreasing_is_first_fit(lengths):
    sizes = np.array(lengths, np.int64)
    bins, offsets = first_fit_decreasing(sizes, 64)
    free: list[int] = []
    want = {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((b for b, f in enumerate(free) if f >= lengths[i]), None)
        if at is None:
            free.append(64)
            at = len(free) - 1
        want[i] = (at, 64 - free[at])
        free[at] -= lengths[i]
    assert [(int(b), int(o)) for b, o in zip(bins, offsets)] == [want[i] for i in range(len(lengths))]


def test_tree_refuses_what_fits_nowhere():
    with pytest.raises(ValueError):
        TournamentTree(2, 8).first_fit(9)


@given(st.integers(1, 9000), st.booleans())
def test_cut_covers(n, fine):
    at = 0
    for start, length in cut(n, 2048, fine):
        assert start == at and 0 < length <= 2048
        at += length
    assert at == n


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string, grp string, hash string, part string")


def test_pack(spark):
    rows = [(i, t, "x", "y", "h", "p") for i, t in enumerate(TRICKY)] + [(3, TRICKY[3], None, None, None, None)] * 40
    rows.append((None, "no id", None, None, None, None))
    got = pack(frame(spark, rows), WORDS, group_pieces=16).toPandas()
    docs: dict = {}
    for r in rows:
        docs.setdefault(r[0], []).append(plain(WORDS, r[1], 1))
    for doc, ids in docs.items():
        own = got[got.doc_id.isna() if doc is None else got.doc_id == doc]
        assert own.length.sum() == sum(map(len, ids)) and set(own.doc_tokens) == {len(ids[0])}
        want = np.array(ids[0], "<u4")
        for p in own.itertuples():
            assert crc(want[p.start : p.start + p.length]) == p.ids_crc32
        spans = own.groupby(["start", "length"]).size()
        assert set(spans) == {len(ids)}
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert pack(frame(spark, []), WORDS).count() == 0


@pytest.mark.parametrize("coding", ["dictionary", "delta"])
def test_token_files(spark, coding):
    rows = [(100 - i, t, "x", "y", "h", "p") for i, t in enumerate(TRICKY)] + [(7, "hot", None, None, None, None)] * 30
    path = work_folder(spark, "test-files")
    write_tokens(frame(spark, rows), path, WORDS, coding=coding)
    want, start = [], 0
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: r[0]):
        ids = plain(WORDS, text, 2)
        want.append((doc, start, len(ids), crc(np.array(ids, "<u4"))))
        start += len(ids)
    got = [tuple(r) for r in checksums(spark, path).collect()]
    assert sorted(got) == want
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in read_numbers(spark, path).collect()) == [w[:3] for w in want]
    some = {r.doc_id: r.ids for r in read_tokens(spark, path, 95, 97).collect()}
    assert some == {r[0]: plain(WORDS, r[1], 2) for r in rows if 95 <= r[0] <= 97}
    plan = read_tokens(spark, path, 95, 97)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,95)" in plan


def test_token_files_empty(spark):
    path = work_folder(spark, "test-files")
    write_tokens(frame(spark, []), path, WORDS)
    assert checksums(spark, path).count() == 0
