"""10. Merkle fingerprints against plain Python on small frames."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from contentlens.llm.fingerprints import (
    CUT, FEW, LONGEST, SINGLE, differing, differing_spans, fingerprint_edits, fingerprint_likeness, leaves, nodes, root, tree,
)

ROWS = [
    (1, "one two three. four five six seven eight nine ten eleven\nnext line here\n\nnew section words"),
    (2, "Élan vital 日本 😀 emoji text, and more words to follow"),
    (3, None),
    (4, ""),
    (5, "x"),
    (6, "long " * 4000),
    (7, "one two three. four five six seven eight nine ten eleven\nnext line here\n\nnew section words"),
    (7, "same id, other text"),
    (8, "rep"),
    (8, "rep"),
    (8, "rep"),
    (None, "no id at all"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], "doc_id long, text string, th string, n string, e string")


def edit(text, following):
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def test_contract(spark):
    got = fingerprint_edits(frame(spark)).withColumn(
        "again", fingerprint_likeness(F.col("fingerprint"), F.col("edited_fingerprint"))
    ).collect()
    assert len(got) == len(ROWS)
    hashes = {r.text: r.h for r in frame(spark).select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    keys = sorted({(i is not None, i or 0, hashes[t], t or "") for i, t in ROWS}, reverse=True)
    texts = [k[3] for k in keys]
    want = {}
    for k, (some, i, _, text) in enumerate(keys):
        e = edit(text, texts[(k + 1) % len(texts)])
        want.setdefault(i if some else None, []).append((len(text), hashlib.sha256(e.encode()).hexdigest()))
    for r in got:
        assert (r.n_chars, r.edited_sha256) in want[r.doc_id]
        assert r.near_edited == r.again and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_id = {r.doc_id: r for r in got}
    one = [r for r in got if r.n_chars == len(ROWS[0][1])]
    assert len({r.fingerprint for r in one}) == 1 and by_id[3].fingerprint == by_id[4].fingerprint
    assert by_id[6].near_edited > 0.6 and len({r.fingerprint for r in got if r.doc_id == 8}) == 1
    assert len({r.fingerprint for r in got}) == len({t or "" for _, t in ROWS})


def test_lone_and_empty(spark):
    (r,) = fingerprint_edits(frame(spark, [(1, "abcdef")])).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprint_edits(frame(spark, [])).count() == 0


def test_differing_branches_locate_the_edit(spark):
    a = nodes(frame(spark, [(1, "p q\nr s\n\nt u\nv w")]))
    b = nodes(frame(spark, [(1, "p q\nr s\n\nt CHANGED\nv w")]))
    assert [tuple(r) for r in differing(a, b).collect()] == [(1, 1, 0)]
    ha = {r.section: r.section_hash for r in a.collect()}
    hb = {r.section: r.section_hash for r in b.collect()}
    assert ha[0] == hb[0] and ha[1] != hb[1]


def test_native(spark):
    plan = fingerprint_edits(frame(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def whole(spark, texts):
    """(root, set of leaves) of each text through the operator's own columns."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    t = rows.select("i", tree(F.col("text")).alias("t")).select("i", root(F.col("t")).alias("r"), leaves(F.col("t")).alias("l"), "t")
    return [(r.r, r.l, r.t) for r in t.orderBy("i").collect()]


def dice(a, b):
    return 1.0 if a[0] == b[0] else 2 * (Counter(a[1]) & Counter(b[1])).total() / (len(a[1]) + len(b[1]))


def plain_tree(text, cuts):
    """Root and spans (as tuples) of a text in plain Python; ``cuts`` are the words that end a span."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    blanks = re.findall(r"\n([ \t]*)\n", text)
    sections = [s.split("\n") for s in re.split(r"\n[ \t]*\n", text)]
    top = sha(";".join([",".join(sha(",".join(map(sha, s))) for s in sections), ",".join(blanks)]))
    found = []
    for p in (p for s in sections for p in s):
        w = p.split(" ")
        if len(w) <= SINGLE:
            found += [(x,) for x in w]
            continue
        if len(w) <= FEW:
            found += [("pair", *w[i : i + 2]) for i in range(len(w) - 1)]
            continue
        first = 0
        for i in range(len(w)):
            if i == len(w) - 1 or w[i] in cuts and w[i] != w[i + 1]:
                found += [(k, *w[first + k * LONGEST : min(i + 1, first + (k + 1) * LONGEST)]) for k in range((i - first) // LONGEST + 1)]
                first = i + 1
    return top, found


def test_equals_a_plain_tree(spark):
    rng = random.Random(8)
    words = [f"w{i}é" for i in range(60)] + ["", "😀", "\t"]
    texts = ["", " ", "\n\n", "a", "word " * 200, "\n \n\t\n \n", "x\n\n\ny"]
    for _ in range(25):
        lines = [" ".join(rng.choice(words[: rng.choice([1, 3, 63])]) for _ in range(rng.choice([1, 5, 17, 90, 300]))) for _ in range(rng.randrange(1, 6))]
        texts.append("".join(p + rng.choice(["\n", "\n\n", "\n \t\n"]) for p in lines))
    seen = sorted({w for t in texts for w in re.split(r"[ \n]", t)})
    listed = spark.createDataFrame([(w,) for w in seen], "w string").where(F.pmod(F.xxhash64("w"), F.lit(CUT)) == 0)
    cuts = {r.w for r in listed.collect()}
    number = {}
    for (r, leaf, _), text in zip(whole(spark, texts), texts, strict=True):
        top, found = plain_tree(text, cuts)
        assert r == top and len(leaf) == len(found)
        for span, h in zip(found, leaf, strict=True):
            assert number.setdefault(span, h) == h
    assert len(set(number.values())) == len(number)


def test_edits_leave_other_spans(spark):
    rng = random.Random(2)
    words = [f"v{rng.randrange(10**6)}" for _ in range(600)]
    line = " ".join(words)
    middle = " ".join([*words[:300], "extra", *words[300:]])
    base, front, mid, end, cut = whole(spark, [line, "extra " + line, middle, " ".join([*words[:-10], *"abcdefghij"]), " ".join(words[7:])])
    assert min(dice(base, front), dice(base, mid)) > 0.97 and dice(base, cut) > 0.95 and 0.9 < dice(base, end) < 1
    short = whole(spark, ["a b c d e f g h i", "z a b c d e f g h i"])
    assert dice(*short) > 0.8


def test_blanks_between_sections_count(spark):
    a, b, c, d = whole(spark, ["a\n\nb", "a\n \nb", "a\n\n\nb", "a\nb"])
    assert len({x[0] for x in (a, b, c, d)}) == 4


def test_differing_spans(spark):
    words = [f"u{i}" for i in range(200)]
    a = nodes(frame(spark, [(1, "head\n" + " ".join(words))]))
    b = nodes(frame(spark, [(1, "head\n" + " ".join([*words[:100], "EDIT", *words[101:]]))]))
    got = [tuple(r) for r in differing_spans(a, b).collect()]
    assert 1 <= len(got) <= 2 and all(r[:3] == (1, 0, 1) for r in got)
    assert differing_spans(a, a).isEmpty()


def test_likeness_counts_repeated_spans(spark):
    docs = [(9, "same old line here\n" * 90 + "the end"), (8, "other words " * 60), (7, "same old line here\n" * 30)]
    got = {r.doc_id: r for r in fingerprint_edits(frame(spark, docs)).collect()}
    texts = [t for _, t in docs]
    for k, (i, text) in enumerate(docs):
        own, edited, following = whole(spark, [text, edit(text, texts[(k + 1) % 3]), texts[(k + 1) % 3]])
        assert abs(got[i].near_edited - dice(own, edited)) < 1e-12 and abs(got[i].near_next - dice(own, following)) < 1e-12
    assert got[9].near_edited > 0.6
