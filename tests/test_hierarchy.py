"""Closure, depths and subtree on deep, cyclic and random parent forests."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from contentlens.operators import hierarchy as hier

NODES = "id int, parent_id int"


def walk_up(parent, x):
    """Python reference: ancestors of x with depth, cycle-safe."""
    out, seen, cur, d = {}, set(), parent.get(x), 1
    while cur is not None and cur not in seen:
        seen.add(cur)
        out[cur] = d
        cur, d = parent.get(cur), d + 1
    return out


def closure_pairs(spark, edges, direction="up"):
    df = spark.createDataFrame(edges, NODES)
    return sorted((r["seed"], r["node"], r["depth"]) for r in hier.closure(df, df.select("id"), direction).collect())


def test_deep_chain_and_orphan(spark):
    # chain 1 <- 2 <- ... <- 6, a second root 10 with child 11, orphan 20 -> 99 (missing)
    edges = [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (10, None), (11, 10), (20, 99)]
    df = spark.createDataFrame(edges, NODES)
    anc = sorted(r["id"] for r in hier.ancestors(df, 6).collect())
    assert anc == [1, 2, 3, 4, 5]
    des = sorted(r["id"] for r in hier.descendants(df, 2).collect())
    assert des == [3, 4, 5, 6]
    depths = dict((r["id"], r["depth"]) for r in hier.depths(df).collect())
    assert depths == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 10: 0, 11: 1}  # 20 unreachable
    assert sorted(tuple(r) for r in hier.depth_stats(df).collect()) == [(0, 2), (1, 2), (2, 1), (3, 1), (4, 1), (5, 1)]


def test_cycles_terminate(spark):
    # self-parent 1; 2 <-> 3; 4 -> 5 -> 6 -> 4; 7 hangs below the 3-cycle
    edges = [(1, 1), (2, 3), (3, 2), (4, 5), (5, 6), (6, 4), (7, 4)]
    df = spark.createDataFrame(edges, NODES)
    cyc = sorted(r["id"] for r in hier.cycle_members(df).collect())
    assert cyc == [1, 2, 3, 4, 5, 6]
    assert sorted(r["id"] for r in hier.ancestors(df, 7).collect()) == [4, 5, 6]
    assert sorted(r["id"] for r in hier.ancestors(df, 4).collect()) == [5, 6]  # the seed itself is excluded
    assert hier.depths(df).count() == 0  # no roots


def test_reparent_conflicts(spark):
    cats = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], NODES)
    changes = spark.createDataFrame([(1, 3), (4, 4)], NODES)  # 1 under its grandchild; 4 under itself
    assert sorted(r["id"] for r in hier.reparent_conflicts(cats, changes).collect()) == [1, 4]
    ok = spark.createDataFrame([(3, 4)], NODES)
    assert hier.reparent_conflicts(cats, ok).count() == 0


def test_subtree_depth_three(spark):
    comments = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None), (6, 5)], "id long, parent_id long")
    seeds = spark.createDataFrame([(2,)], "id long")
    assert sorted(r["id"] for r in hier.subtree(comments, seeds).collect()) == [2, 3, 4]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(0, 11)), min_size=1, max_size=12))
def test_random_forest_closure_matches_walk(spark, parents):
    edges = [(i, p) for i, p in enumerate(parents)]
    parent = {i: p for i, p in edges if p is not None}
    want = sorted((x, a, d) for x, _ in edges for a, d in walk_up(parent, x).items())
    assert closure_pairs(spark, edges, "up") == want


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(0, 14)), min_size=1, max_size=14))
def test_depths_and_cycles_match_walk(spark, parents):
    parent = {i: p for i, p in enumerate(parents) if p is not None}
    df = spark.createDataFrame(list(enumerate(parents)), NODES)

    def ends_at_root(i):
        above = walk_up(parent, i)
        top = max(above, key=above.get) if above else i
        return top < len(parents) and parents[top] is None

    want = sorted((i, len(walk_up(parent, i))) for i in range(len(parents)) if ends_at_root(i))
    assert sorted(tuple(r) for r in hier.depths(df).collect()) == want
    cyclic = sorted(i for i in range(len(parents)) if i in walk_up(parent, i))
    assert sorted(r["id"] for r in hier.cycle_members(df).collect()) == cyclic


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(0, 11)), min_size=1, max_size=12))
def test_random_forest_closure_down(spark, parents):
    edges = list(enumerate(parents))
    parent = {i: p for i, p in edges if p is not None}
    want = sorted((a, x, d) for x, _ in edges for a, d in walk_up(parent, x).items() if a < len(parents))
    assert closure_pairs(spark, edges, "down") == want


def test_chains_of_9_100_and_12000(spark):
    for n in (9, 100, 12_000):
        df = spark.range(n).selectExpr("cast(id as int) id", "cast(if(id = 0, null, id - 1) as int) parent_id")
        up = hier.closure(df, df.where(f"id = {n - 1}").select("id"), "up")
        assert up.count() == n - 1 and up.agg({"depth": "max"}).first()[0] == n - 1
        down = hier.closure(df, df.where("id = 0").select("id"), "down")
        assert down.count() == n - 1 and down.where("depth <> node").count() == 0
        assert hier.subtree(df, df.where("id = 5").select("id")).count() == n - 5
        assert hier.depths(df).where("depth <> id").count() == 0 and hier.depths(df).count() == n
        assert hier.cycle_members(df).count() == 0


def test_subtree_within_groups(spark):
    rows = [(1, None, 7), (2, 1, 7), (3, 2, 7), (4, None, 8), (5, 4, 8), (6, None, 9)]
    df = spark.createDataFrame(rows, "id long, parent_id long, post_id long")
    seeds = spark.createDataFrame([(2,), (4,)], "id long")
    assert sorted(r["id"] for r in hier.subtree(df, seeds, within="post_id").collect()) == [2, 3, 4, 5]


def test_doubling_long_chain(spark):
    n = 300
    df = spark.createDataFrame([(0, None)] + [(i, i - 1) for i in range(1, n)] + [(n, n + 1), (n + 1, n)], NODES)
    got = dict((r["id"], r["depth"]) for r in hier.depths(df).collect())
    assert got == {i: i for i in range(n)}  # the 2-cycle at the end is left out


def test_subtree_deep_chain(spark):
    n = 60
    edges = [(0, None)] + [(i, i - 1) for i in range(1, n)] + [(100, None), (101, 100), (200, 201), (201, 200)]
    df = spark.createDataFrame(edges, "id long, parent_id long")
    seeds = spark.createDataFrame([(5,)], "id long")
    assert sorted(r["id"] for r in hier.subtree(df, seeds).collect()) == list(range(5, n))
    cyc_seed = spark.createDataFrame([(200,)], "id long")
    assert sorted(r["id"] for r in hier.subtree(df, cyc_seed).collect()) == [200, 201]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(0, 14)), min_size=1, max_size=14), st.sets(st.integers(0, 14), max_size=3))
def test_marked_by_ancestor_matches_walk(spark, parents, marks):
    edges = [(i, p) for i, p in enumerate(parents)]
    parent = {i: p for i, p in edges if p is not None}
    ids = {i for i, _ in edges} | set(marks)
    want = sorted(x for x in ids if x in marks or any(a in marks for a in walk_up(parent, x)))
    df = spark.createDataFrame(edges, NODES)
    m = spark.createDataFrame([(x,) for x in marks], "id int")
    assert sorted(r["id"] for r in hier.marked_by_ancestor(df, m).collect()) == want


def test_closure_up_deep_chain(spark):
    n = 40
    edges = [(0, None)] + [(i, i - 1) for i in range(1, n)] + [(100, 101), (101, 102), (102, 100)]
    for i in range(103, 115):
        edges.append((i, i - 1))  # a chain hanging under the 3-cycle
    df = spark.createDataFrame(edges, NODES)
    parent = {i: p for i, p in edges if p is not None}
    for seed in (n - 1, 114):
        want = sorted((seed, a, d) for a, d in walk_up(parent, seed).items())
        seeds = spark.createDataFrame([(seed,)], "id int")
        got = sorted((r["seed"], r["node"], r["depth"]) for r in hier.closure(df, seeds, "up").collect())
        assert got == want, seed
    assert sorted(r["id"] for r in hier.ancestors(df, n - 1).collect()) == list(range(n - 1))
