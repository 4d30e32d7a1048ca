"""11. Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from contentlens.llm import spelling as sp


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary(docs, every, least=7, count=2):
    total = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= count}


def variants(words, ratio=10):
    out = {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best and words[best] >= ratio * n else None, len(others))
    rows = []
    for w, (form, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, words[w], k, words[form] if form else None))
    return sorted(rows)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def typo(rng, word, letters="abcdeé"):
    i = rng.randrange(len(word) + 1)
    kind = rng.randrange(3)
    if kind == 0:
        return word[:i] + rng.choice(letters) + word[i:]
    i = min(i, len(word) - 1)
    return word[:i] + (rng.choice(letters) if kind == 1 else "") + word[i + 1 :]


def test_one_error_equals_brute_force():
    rng = random.Random(4)
    for size in (1, 2, 40, 130):
        words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(size)}
        words = sorted(words | {typo(rng, w) for w in list(words)} - {""})
        allowed = np.random.default_rng(1).random((len(words),) * 2) < 0.9
        np.fill_diagonal(allowed, False)
        bits = sp.one_error(words, allowed)
        found = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little")[:, : len(words)].astype(bool)
        want = np.array([[near(a, b) for b in words] for a in words]) & allowed
        assert (found == want).all()


@pytest.mark.parametrize("index, block", [(512, 2048), (8, 6)])
def test_variants_equal_brute_force(spark, monkeypatch, index, block):
    monkeypatch.setattr(sp, "INDEX", index)
    monkeypatch.setattr(sp, "BLOCK", block)
    rng = random.Random(index)
    words = {}
    for _ in range(60):
        # common halves make large buckets
        w = rng.choice(["abcabc", "bcabca", "", "aaaa"]) + "".join(rng.choice("abcé") for _ in range(rng.randrange(2, 6)))
        words[w] = rng.choice([3, 40, 40, 500, 7000])
    for w in list(words):
        for _ in range(4):
            words.setdefault(typo(rng, w), rng.choice([2, 4, 50]))
    for w in [w for w in words if len(w) < 4]:
        del words[w]
    words["x" * 5000] = 30
    words["x" * 4999 + "y"] = 3
    frame = spark.createDataFrame([(w, n, 1) for w, n in words.items()] + [(None, 5, 1)], "word string, n long, key int")
    assert got(sp.spelling_variants(frame, least_length=4)) == variants(words)


def test_documents_with_slips(spark):
    rng = random.Random(9)
    base = ["Réseaux", "ordinaire", "ORDINAIRE", "ordinaires", "ÀÉÎÕÜàé", "×÷ßþÿðæ", "keyboards", "short", "extraordinary"]
    docs = [(i % 150 if i % 19 else None, " ".join(rng.choice(base) for _ in range(rng.randrange(40)))) for i in range(300)]
    docs += [(900, None), (901, ""), (902, "ordinaire" * 2000), (902, "ordinaire" * 2000), (903, "1234 +-*/ дом 漢字")]
    frame = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    want = vocabulary(docs, 31)
    assert got(sp.variants_of_documents(frame, slip_every=31)) == variants(want)
    assert len(want) > len(vocabulary(docs, None))


def test_tasks_hand_on_what_they_hold(spark, monkeypatch):
    monkeypatch.setattr(sp, "HELD_WORDS", 2)
    docs = [(i, f"alphabet wonderful {'q' * (7 + i % 5)}") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["word"]: r["n"] for r in sp.word_counts(frame).collect()} == vocabulary(docs, None)


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert got(sp.variants_of_documents(frame, slip_every=31)) == []


def test_query_over_given_documents(spark):
    from contentlens.llm.catalog import QUERIES

    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op11_spelling_variants"](spark, path)) == variants(vocabulary(docs, 31))
