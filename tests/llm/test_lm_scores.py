"""3. Stupid-backoff scores against a plain Python count."""

import math
import random
import re
from collections import Counter

import pytest

from contentlens.llm.lm_scores import backoff_scores


def brute(rows, order=3, alpha=0.4):
    docs = [[w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower()) if w] for _, t in rows]

    def grams(w):
        return Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))

    own = [grams(w) for w in docs]
    total = sum(own, Counter())
    words = sum(map(len, docs))
    out = []
    for (doc, _), w, mine in zip(rows, docs, own, strict=True):
        def c(g, mine=mine):
            return total[g] - mine[g]

        score, used = 0.0, Counter()
        for i in range(len(w)):
            top = min(i + 1, order)
            for n in range(top, 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if c(g) > 0:
                    below = c(g[:-1]) if n > 1 else max(1, words - len(w))
                    score += math.log(c(g) / below * alpha ** (top - n))
                    used[n] += 1
                    break
            else:
                score += math.log(alpha**top / max(1, words - len(w)))
                used[0] += 1
        out.append((doc, len(w), score, *(used[n] for n in range(order + 1))))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, block long, n_words long")


def sample(seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choices(["the", "a", "cat", "Dog.", "ran", "été", "x1", "of"], k=rng.randint(0, 60)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "!!! ..."), (103, "the cat " * 2000), (104, "unheard words only"), (None, "the cat ran")]
    return rows + [rows[3]] * 25


@pytest.mark.parametrize(("bucket_chars", "block_words"), [(1 << 20, 10**6), (256, 150)])
def test_brute_force(spark, bucket_chars, block_words):
    rows = sample(bucket_chars)
    got = backoff_scores(frame(spark, rows), bucket_chars=bucket_chars, block_words=block_words).collect()
    mine = sorted(((r.doc_id, r.n_words, r.log_score, r.n_order0, r.n_order1, r.n_order2, r.n_order3) for r in got), key=str)
    want = brute(rows)

    def key(r):
        return (str(r[0]), r[1], *r[3:])

    for a, b in zip(sorted(mine, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[3:] == b[3:] and math.isclose(a[2], b[2], rel_tol=1e-9, abs_tol=1e-9)
    for r in got:
        assert (r.mean_log is None) == (r.n_words == 0)


def test_empty_and_lone(spark):
    assert backoff_scores(frame(spark, [])).count() == 0
    (r,) = backoff_scores(frame(spark, [(1, "one two one")])).collect()
    assert r.n_order0 == 3 and math.isclose(r.log_score, math.log(0.4) * 6)
