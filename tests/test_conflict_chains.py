"""V1 on chains of conflicts: the result of a one-by-one replay in few rounds."""

import random

import pytest

from contentlens.operators import components
from contentlens.operators import quality as qa

ROWS = "id bigint, email string, username string"


def replay(rows):
    emails, names, ok = set(), set(), set()
    for i, e, n in sorted(rows):
        if e not in emails and n not in names:
            ok.add(i)
            emails.add(e)
            names.add(n)
    return ok


def accepted(spark, rows):
    none = spark.createDataFrame([], "email string, username string")
    out = qa.validate_users(spark.createDataFrame(rows, ROWS), none, order="id").where("size(reasons) = 0")
    return {r["id"] for r in out.select("id").collect()}


def chain(n, order):
    """Row k of the chain shares its email or username with row k - 1."""
    return [(order[k], f"p{k // 2}@x.org", f"name{(k + 1) // 2}") for k in range(n)]


@pytest.mark.parametrize("largest", [1_000_000, 7])
@pytest.mark.parametrize("seed", range(3))
def test_random_batches(spark, monkeypatch, seed, largest):
    monkeypatch.setattr(qa, "REPLAY_ROWS", largest)
    rng = random.Random(seed)
    rows = [(i, f"e{rng.randrange(30)}@x.org", f"name{rng.randrange(30)}") for i in range(50)]
    ids = rng.sample(range(1000, 2000), 60)
    rows += [(i, f"c{e}", f"c{n}") for i, e, n in chain(40, sorted(ids)[:40])]
    rows += [(i, f"d{e}", f"d{n}") for i, e, n in chain(20, ids[40:])]
    assert accepted(spark, rows) == replay(rows)


def test_long_chain_in_few_rounds(spark, monkeypatch):
    rounds = []
    step = components.hook_round
    monkeypatch.setattr(components, "hook_round", lambda e, f: rounds.append(1) or step(e, f))
    n = 100_000
    rows = chain(n, list(range(n)))
    assert accepted(spark, rows) == set(range(0, n, 2))
    assert len(rounds) < 25


def test_one_email_for_most_rows(spark, monkeypatch):
    monkeypatch.setattr(qa, "REPLAY_ROWS", 50)
    rows = [(i, "all@x.org" if i % 3 else f"e{i // 6}@x.org", f"name{i // 2}") for i in range(600)]
    assert accepted(spark, rows) == replay(rows)
