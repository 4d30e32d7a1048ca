"""13. Hard-negative mining over an STR-packed R-tree.

Vectors are cut into tiles by sort-tile-recursive boundaries, and each tile's
rows are packed the same way into the leaves of a tree with minimum bounding
boxes.  Against an anchor a box gives, coordinate by coordinate, the least and
the largest inner product that a row inside can have.  A best-first queue
takes the box with the largest possible score next and drops boxes whose
interval misses the score window, or lies strictly below the kth score found.

Only the tile boundaries are fitted on a sample (``sample`` rows, the least by
hash); every row is indexed.  A tile with more rows than a tree may hold
becomes several trees.  The anchors, a stated query set, are packed into
blocks; a block meets the trees in a number of lanes, each a stream of trees
that keeps its anchors' best rows so far, so neither a block nor a tree grows
with the data and a lost executor repeats its lanes only.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentlens.llm.common import bounded_batches, sorted_groups, stored

#: Numbers of a tree (rows times places), rows of a leaf, children of a node.
TREE_VALUES, LEAF, FANOUT = 262_144, 64, 8
#: Anchors of a block; rows on which the tile boundaries are fitted; tiles at most.
BLOCK, SAMPLE, TILES = 1024, 16_384, 1024
#: Coordinates along which tiles are cut.
CUT_DIMS = 3
#: Inner products below this are exact in floating point.
EXACT = float(1 << 53)

_ROWS = "vec_id long, label long, dim int, vec binary"
_TREE = "tree long, dim int, ids binary, labels binary, ties binary, vecs binary, lo binary, hi binary"


def usable_rows(rows: DataFrame, vec_id: str, vector: str, label: str | Column, scale: float) -> DataFrame:
    """vec_id, label, dim, vec (the floored components, in the type of the
    vector's) of the rows that take part; equal rows of a batch come once."""
    kind = np.float64 if rows.schema[vector].dataType.elementType.typeName() != "float" else np.float32
    of = F.col(f"`{label}`") if isinstance(label, str) else label
    base = bounded_batches(rows).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), of.cast("long").alias("label"), F.col(f"`{vector}`").alias("vector")
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, lists = batch.columns
            at = lists.offsets.to_numpy()
            flat = lists.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).astype(np.float64)
            at = at - at[0]
            good = np.concatenate(([0], np.cumsum(np.isfinite(flat))))  # nulls come as NaN
            whole = good[at[1:]] - good[at[:-1]] == np.diff(at)
            with np.errstate(invalid="ignore", over="ignore"):
                parts = (np.floor(flat * scale) + 0.0).astype(kind)  # no minus zero
            out: dict[tuple, None] = {}
            for i, (v, c) in enumerate(zip(ids.to_pylist(), labels.to_pylist(), strict=True)):
                if whole[i]:
                    out[v, c, parts[at[i] : at[i + 1]].tobytes()] = None
            vecs = [k[2] for k in out]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in out], pa.int64()),
                    pa.array([k[1] for k in out], pa.int64()),
                    pa.array([len(v) // kind().itemsize for v in vecs], pa.int32()),
                    pa.array(vecs, pa.binary()),
                ],
                names=["vec_id", "label", "dim", "vec"],
            )

    return base.mapInArrow(run, _ROWS)


def matrix(vecs: list[bytes], dim: int, kind: type) -> np.ndarray:
    """Vectors as rows of a matrix; a shorter vector ends in zeros."""
    if vecs and all(len(v) == dim * kind().itemsize for v in vecs):
        return np.frombuffer(b"".join(vecs), kind).reshape(len(vecs), dim)
    out = np.zeros((len(vecs), dim), kind)
    for i, v in enumerate(vecs):
        row = np.frombuffer(v, kind)
        out[i, : len(row)] = row
    return out


class Tiles:
    """Sort-tile-recursive boundaries: slabs along one coordinate, each cut
    along the next."""

    def __init__(self, rows: np.ndarray, tiles: int):
        dims = min(CUT_DIMS, rows.shape[1]) if len(rows) else 0
        self.dims = np.argsort(-(rows.max(0) - rows.min(0)), kind="stable")[:dims].tolist() if dims else []
        self.slabs = max(1, math.ceil(tiles ** (1 / dims))) if dims else 1
        self.count = self.slabs ** len(self.dims)
        self.cuts: list[list[np.ndarray]] = []
        parts = [rows]
        for d in self.dims:
            level, after = [], []
            for part in parts:
                values = np.sort(part[:, d])
                cut = values[[len(values) * k // self.slabs for k in range(1, self.slabs)]] if len(values) else values
                level.append(cut)
                place = np.searchsorted(cut, part[:, d], side="right")
                after += [part[place == k] for k in range(self.slabs)]
            self.cuts.append(level)
            parts = after

    def of(self, rows: np.ndarray) -> np.ndarray:
        tile = np.zeros(len(rows), np.int64)
        for d, level in zip(self.dims, self.cuts, strict=True):
            slab = np.zeros(len(rows), np.int64)
            for t in np.unique(tile).tolist():
                own = tile == t
                slab[own] = np.searchsorted(level[t], rows[own, d], side="right")
            tile = tile * self.slabs + slab
        return tile


def str_order(rows: np.ndarray, leaf: int) -> np.ndarray:
    """Row numbers in sort-tile-recursive order: every ``leaf`` of them are a leaf."""
    spread = np.argsort(-(rows.max(0) - rows.min(0)), kind="stable").tolist() if rows.size else []

    def pack(own: np.ndarray, dims: list[int]) -> np.ndarray:
        pages = -(-len(own) // leaf)
        if pages <= 1 or not dims:
            return own
        own = own[np.argsort(rows[own, dims[0]], kind="stable")]
        if len(dims) == 1:
            return own
        step = -(-pages // math.ceil(pages ** (1 / len(dims)))) * leaf
        return np.concatenate([pack(own[i : i + step], dims[1:]) for i in range(0, len(own), step)])

    return pack(np.arange(len(rows)), spread[:CUT_DIMS])


def levels_of(n: int) -> list[tuple[int, int]]:
    """(first node, nodes) of each level of a tree of n rows, leaves first."""
    out, count, first = [], max(1, -(-n // LEAF)), 0
    while True:
        out.append((first, count))
        if count == 1:
            return out
        first, count = first + count, -(-count // FANOUT)


def boxes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest coordinates of every node, leaves first, the root last."""
    lo = [np.minimum.reduceat(rows, np.arange(0, len(rows), LEAF))]
    hi = [np.maximum.reduceat(rows, np.arange(0, len(rows), LEAF))]
    while len(lo[-1]) > 1:
        at = np.arange(0, len(lo[-1]), FANOUT)
        lo.append(np.minimum.reduceat(lo[-1], at))
        hi.append(np.maximum.reduceat(hi[-1], at))
    return np.concatenate(lo), np.concatenate(hi)


def _groups(keys: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)])).tolist()
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _packed(rows: DataFrame, key: str, dim: int, kind: type, tree: bool) -> DataFrame:
    """One row of arrays per ``key``: a tree in packed order with its boxes, or
    a block of anchors in the order of id, label and tie."""

    def act(part: pa.Table) -> pa.Table | None:
        out: dict[str, list] = {k: [] for k in ("tree", "dim", "ids", "labels", "ties", "vecs", "lo", "hi")}
        keys, ids, labels = (part.column(c).to_numpy() for c in (key, "vec_id", "label"))
        vecs = part.column("vec").to_pylist()
        for a, b in _groups(keys):
            kept = list({(int(ids[i]), int(labels[i]), vecs[i]): i for i in range(a, b)}.values())  # equal rows are one
            own = matrix([vecs[i] for i in kept], dim, kind)
            tie = np.array([xxhash.xxh3_64_intdigest(vecs[i]) >> 1 for i in kept], np.int64)
            order = np.lexsort((tie, labels[kept], ids[kept]))
            if tree:
                order = order[str_order(own[order], LEAF)]
            own = np.ascontiguousarray(own[order])
            lo, hi = boxes(own) if tree else (own[:0], own[:0])
            values = (int(keys[a]), dim, ids[kept][order], labels[kept][order], tie[order], own, lo, hi)
            for name, v in zip(out, values, strict=True):
                out[name].append(v.tobytes() if isinstance(v, np.ndarray) else v)
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), _types(), strict=True)], names=list(out))

    def run(batches):
        return sorted_groups(batches, key, act, 4096)

    dealt = rows.select(key, "vec_id", "label", "vec").repartition(F.col(key)).sortWithinPartitions(key)
    return dealt.mapInArrow(run, _TREE)


def _types() -> list[pa.DataType]:
    return [pa.int64(), pa.int32(), *[pa.binary()] * 6]


def index_rows(rows: DataFrame, dim: int, kind: type, n: int, tree_values: int, sample: int) -> DataFrame:
    """The trees over all ``rows`` (usable and stored), one row each."""
    tree_rows = max(LEAF, tree_values // max(1, dim))
    bound = max(LEAF, min(sample, (32 << 20) // max(1, dim * kind().itemsize)))
    some = rows.orderBy(F.xxhash64("vec_id", "label", "vec")).select("vec").limit(bound)  # bounded by rows and bytes
    tiles = Tiles(matrix([bytes(r[0]) for r in some.collect()], dim, kind), min(TILES, -(-n // tree_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tile = tiles.of(matrix(batch.column("vec").to_pylist(), dim, kind))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile)], names=[*batch.schema.names, "tile"])

    tiled = rows.mapInArrow(run, f"{_ROWS}, tile long")
    full = {r["tile"]: -(-r["n"] // tree_rows) for r in tiled.groupBy("tile").agg(F.count("*").alias("n")).collect()}  # TILES at most
    parts = F.create_map(*[F.lit(x) for t, k in full.items() if k > 1 for x in (t, k)]) if any(k > 1 for k in full.values()) else None
    several = F.coalesce(parts[F.col("tile")], F.lit(1)) if parts is not None else F.lit(1)
    part = F.pmod(F.xxhash64("vec_id", "label", "vec"), several)
    return _packed(tiled.withColumn("tree", F.col("tile") * F.lit(1 << 32) + part), "tree", dim, kind, True)


class Tree:
    """A packed tree, or a block of anchors, as it comes to a task."""

    def __init__(self, row: dict, kind: type):
        self.dim = row["dim"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.labels, self.ties = (np.frombuffer(row[c], np.int64) for c in ("labels", "ties"))
        self.rows = np.frombuffer(row["vecs"], kind).reshape(len(self.ids), self.dim).astype(np.float64)
        self.lo, self.hi = (np.frombuffer(row[c], kind).reshape(-1, self.dim).astype(np.float64) for c in ("lo", "hi"))
        self.largest = float(np.abs(self.rows).max(initial=0.0))


class Search:
    """Best rows of one window of one anchor: at most ``k`` tuples (minus score,
    id, label, tie), best first."""

    __slots__ = ("best", "hi", "k", "lo")

    def __init__(self, k: int, lo: float = -math.inf, hi: float = math.inf):
        self.k, self.lo, self.hi, self.best = k, lo, hi, []

    def floor(self) -> float:
        """Scores strictly below it are of no use."""
        return max(self.lo, -self.best[-1][0]) if len(self.best) == self.k else self.lo

    def wants(self, least: float, most: float) -> bool:
        return least <= self.hi and most >= self.floor()

    def add(self, found: list[tuple]) -> None:
        self.best = heapq.nsmallest(self.k, [*self.best, *found]) if len(found) > 4 * self.k else sorted([*self.best, *found])[: self.k]


def _scores(tree: Tree, a: int, b: int, vector: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return tree.rows[a:b] @ vector
    own = [int(x) for x in vector]
    return np.array([sum(int(x) * y for x, y in zip(row, own, strict=True)) for row in tree.rows[a:b].tolist()], object)


def best_first(tree: Tree, anchors: Tree, searches: list[list[Search]], same: bool) -> None:
    """Carry every anchor's searches over the rows of a tree that have its
    label (``same``, the anchor itself left out) or another."""
    exact = tree.dim * tree.largest * anchors.largest < EXACT
    levels = levels_of(len(tree.ids))
    root, leaves = levels[-1][0], levels[0][1]
    first_child = {}
    for (below, count), (first, nodes) in zip(levels, levels[1:], strict=False):
        for k in range(nodes):
            first_child[first + k] = (below + k * FANOUT, below + min(count, (k + 1) * FANOUT))
    up, down = np.maximum(anchors.rows, 0), np.minimum(anchors.rows, 0)
    with np.errstate(invalid="ignore", over="ignore"):
        most = (up @ tree.hi.T + down @ tree.lo.T) if exact else np.full((len(anchors.ids), len(tree.lo)), np.inf)
        least = (up @ tree.lo.T + down @ tree.hi.T) if exact else np.full((len(anchors.ids), len(tree.lo)), -np.inf)
    for i, own in enumerate(searches):
        if not own:
            continue
        hi, lo, vector, label = most[i].tolist(), least[i].tolist(), anchors.rows[i], anchors.labels[i]
        queue = [(-hi[root], root)]
        while queue:
            bound, node = heapq.heappop(queue)
            open_ = [s for s in own if s.wants(lo[node], -bound)]
            if not open_:
                # boxes come by falling bound: none left can reach a search whose floor is above it
                if all(-bound < s.floor() for s in own):
                    break
                continue
            if node >= leaves:
                for child in range(*first_child[node]):
                    if any(s.wants(lo[child], hi[child]) for s in open_):
                        heapq.heappush(queue, (-hi[child], child))
                continue
            a, b = node * LEAF, min((node + 1) * LEAF, len(tree.ids))
            score = _scores(tree, a, b, vector, exact)
            right = (tree.labels[a:b] == label) == same
            if same:
                right &= ~((tree.ids[a:b] == anchors.ids[i]) & (tree.ties[a:b] == anchors.ties[i]))
            for s in open_:
                hit = np.flatnonzero(right & (score >= s.floor()) & (score <= s.hi))
                if len(hit):
                    at = hit + a
                    s.add(list(zip(
                        [-int(x) for x in score[hit]], tree.ids[at].tolist(), tree.labels[at].tolist(), tree.ties[at].tolist(), strict=True
                    )))


def window_of(positive: int, low: int, high: int) -> tuple[float, float]:
    """Least and largest whole score s with low*positive <= 100*s <= high*positive."""
    return -(-low * positive // 100), high * positive // 100


_FOUND = "block long, pos int, wanted int, anchor_id long, score long, vec_id long, label long, tie long"


def _searched(anchors: DataFrame, trees: DataFrame, blocks: int, n_trees: int, kind: type, k: int, window: tuple[int, int] | None) -> DataFrame:
    """Best rows of every anchor in each lane.  ``anchors`` has a column
    ``wanted`` (pos, number, score of its positives) if ``window`` is given."""
    spark = anchors.sparkSession
    lanes = max(1, min(n_trees, -(-3 * spark.sparkContext.defaultParallelism // blocks)))
    per_block = anchors.select(
        F.col("tree").alias("block"), F.lit(-1).cast("long").alias("tree"), *anchors.columns[1:],
        F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
    )
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    none = [] if window is None else [F.lit(None).cast(anchors.schema["wanted"].dataType).alias("wanted")]
    per_tree = trees.select(
        block.alias("block"), "tree", *trees.columns[1:], *none, F.pmod(F.xxhash64("tree"), F.lit(lanes)).cast("int").alias("lane")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, searches = None, []

        def result() -> Iterator[pa.RecordBatch]:
            out = [
                (held_block, i, w, int(held.ids[i]), -s, v, c, t)
                for i, own in enumerate(searches) for w, search in zip(numbers[i], own, strict=True) for s, v, c, t in search.best
            ]
            cols = [pa.array([r[c] for r in out], pa.int32() if c in (1, 2) else pa.int64()) for c in range(8)]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "pos", "wanted", "anchor_id", "score", "vec_id", "label", "tie"])

        held_block, numbers = -1, []
        for batch in batches:
            for j in range(batch.num_rows):
                row = {c: batch.column(c)[j].as_py() for c in batch.schema.names}
                if row["tree"] >= 0:
                    if held is not None and held_block == row["block"]:
                        best_first(Tree(row, kind), held, searches, window is None)
                    continue
                if held is not None:
                    yield from result()
                held, held_block = Tree(row, kind), row["block"]
                n = len(held.ids)
                if window is None:
                    searches, numbers = [[Search(k)] for _ in range(n)], [[0]] * n
                    continue
                searches, numbers = [[] for _ in range(n)], [[] for _ in range(n)]
                for w in row["wanted"] or []:
                    lo, hi = window_of(w["score"], *window)
                    if lo <= hi:
                        searches[w["pos"]].append(Search(k, lo, hi))
                        numbers[w["pos"]].append(w["number"])
        if held is not None:
            yield from result()

    both = per_block.unionByName(per_tree)
    dealt = both.repartition(max(1, blocks * lanes), "block", "lane").sortWithinPartitions("block", "lane", "tree")
    return dealt.mapInArrow(run, _FOUND)


def hard_negatives(
    rows: DataFrame,
    anchors: Column | None = None,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str | Column = "label",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    tree_values: int = TREE_VALUES,
    sample: int = SAMPLE,
    block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); scores are inner products, higher
    first, ties by the smaller id, then label, then a hash of the vector.  An
    anchor (a row for which ``anchors``, a condition on ``vec_id`` and
    ``label``, holds; every hundredth id if not given) has as positives its
    first ``positives`` other rows of its label; for each of them the first
    ``negatives`` rows of other labels with a score between ``low`` and
    ``high`` percent of the positive's come back, ranked from 1.  All are
    returned where there are fewer; a negative positive score has an empty
    window.

    Rows without id, label or vector, or with a null or non-finite component
    take no part.  Equal rows (id, label and vector) are one row; rows of one
    id that differ are different rows.  A shorter vector counts as ended with
    zeros.  Scores beyond 2^53 are exact too (by a slower path), beyond 2^63
    the job fails.  An empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    kind = np.float64 if rows.schema[vector].dataType.elementType.typeName() != "float" else np.float32
    known = stored(usable_rows(rows, vec_id, vector, label, scale), "vectors")
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.max("dim"), F.lit(0)).alias("dim")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    asked = known.where(anchors if anchors is not None else F.col("vec_id") % 100 == 0).distinct()
    n_anchors = asked.count()
    if not n_anchors:
        return spark.createDataFrame([], out)
    trees = stored(index_rows(known, max(1, size["dim"]), kind, size["n"], tree_values, sample), "trees")
    n_trees, blocks = trees.count(), -(-n_anchors // block)
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "vec"), F.lit(blocks)))
    queries = stored(_packed(dealt, "block", max(1, size["dim"]), kind, False), "anchors")

    better = [F.desc("score"), "vec_id", "label", "tie"]
    first = _searched(queries, trees, blocks, n_trees, kind, positives, None)
    number = F.row_number().over(Window.partitionBy("block", "pos").orderBy(*better))  # positives x lanes rows
    best = first.withColumn("number", number).where(F.col("number") <= positives)
    best = stored(best.select("block", "pos", "number", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    wanted = best.groupBy(F.col("block").alias("tree")).agg(  # block x positives at most
        F.collect_list(F.struct("pos", "number", F.col("positive_score").alias("score"))).alias("wanted")
    )
    found = _searched(queries.join(wanted, "tree"), trees, blocks, n_trees, kind, negatives, (low, high))
    rank = F.row_number().over(Window.partitionBy("block", "pos", "wanted").orderBy(*better))  # negatives x lanes rows
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= negatives).withColumnRenamed("wanted", "number")
    ranked = ranked.select("block", "pos", "number", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return ranked.join(best, ["block", "pos", "number"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM (SELECT DISTINCT vec_id, label, embedding FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
         CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM r AS a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
