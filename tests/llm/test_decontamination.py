"""4. Containment search against brute force."""

import random
import re

import pytest

from contentlens.llm import decontamination as dc


def grams(text, width=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    k = min(width, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def brute(docs, items):
    out = {}
    for i, text in items:
        q = grams(text)
        if not q:
            continue
        k = len(next(iter(q)))
        for d, doc in docs:
            shared = len(q & {g for g in (grams(doc, k)) if len(g) == k})
            if shared and 10 * shared >= 8 * len(q):
                key = (d, i)
                out[key] = max(out.get(key, (0, 0)), (shared, len(q)))
    return sorted((d if d is not None else -1, i, n, s) for (d, i), (s, n) in out.items())


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, "s", "x") for d, t in docs], "doc_id long, text string, shingle string, size string"),
        spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, width string"),
    )


def sample(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "!!"), (93, "w1 w2"), (94, items[0][1].upper())]
    docs: list = [(90, None), (91, ""), (92, " ".join(rng.choices(vocabulary, k=30000)))]
    for d in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 80))
        chosen = rng.choice(items[:25])[1].split()
        for _ in range(rng.randint(0, 3)):
            chosen[rng.randrange(len(chosen))] = "changed"
        docs.append((d, " ".join(words[:20] + chosen + words[20:])))
    docs += [docs[5]] * 30 + [(6, docs[7][1]), (None, docs[8][1])]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("broadcast", [True, False])
def test_brute_force(spark, monkeypatch, seed, broadcast):
    if not broadcast:
        monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    docs, items = sample(seed)
    got = dc.contaminated(*frames(spark, docs, items)).collect()
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id, r.n_shingles, r.n_shared) for r in got)
    assert rows == brute(docs, items) and rows
    assert all(r.containment == r.n_shared / r.n_shingles for r in got)


@pytest.mark.parametrize("broadcast", [True, False])
def test_repeated_and_null_item_ids(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(dc, "BROADCAST_ROWS", 0)
    docs, items = sample(3)
    texts = {i: t for i, t in items}
    ids = {i: None if i is not None and i % 3 == 0 else i % 2 for i in texts}
    same = [(ids[i], t) for i, t in items]
    docs_frame, items_frame = frames(spark, docs, same + same[:3])
    got = dc.contaminated(docs_frame, items_frame).collect()
    want = set()  # an item is its id and its words
    for d, i, n, s in brute(docs, items):
        want.add((d, ids[i], tuple(re.findall(r"[^\W_]+", texts[i].lower())), n, s))
    key = str
    assert sorted(((r.doc_id if r.doc_id is not None else -1, r.item_id, r.n_shingles, r.n_shared) for r in got), key=key) == sorted(
        ((d, i, n, s) for d, i, _, n, s in want), key=key
    )
    left = {r.doc_id for r in dc.clean(docs_frame, items_frame).where("doc_id < 60").collect()}
    found = {d for d, *_ in want}
    assert found & set(range(60)) and not left & (found - {6})  # id 6 has two texts


def test_empty_tables(spark):
    docs, items = frames(spark, [], [])
    some, bench = frames(spark, [(1, "a b c d e f")], [(1, "a b c d e f")])
    assert dc.contaminated(docs, bench).count() == 0
    assert dc.contaminated(some, items).count() == 0


def test_native(spark):
    docs, items = frames(spark, *sample(1))
    plan = dc.contaminated(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
