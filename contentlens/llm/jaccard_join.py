"""5. N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles, embedded as MinHash signatures.  A run
begins at one place of the signature: sets with the same value there share a
bucket.  A bucket that is too large is split again: a node samples places (by
a hash of node and place, BRANCH on average), and each set goes to the children
of its values there, until buckets are small.  A child that keeps half of its
parent's sets is dense: splitting it further would part few of them, so it is
compared as it is.  A pair at the threshold shares more than one child of a
split on average, so it is met with the same chance at any depth, and runs are
repeated until that chance reaches the target recall.

Equal sets are joined as one, with their count.  Inside a bucket signatures
are compared by brute force; sets that look alike are chained, never listed
pair by pair.  The chains' components are small families of alike sets; each
family's shingle sets are fetched once and compared exactly.  A bucket or
family larger than a block is compared block against block in separate tasks,
so no group lands in one task and no pair becomes a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.llm.common import BROADCAST_KEYS, bounded_batches, connected_components, free_names, pieces_of, sorted_groups, stored, without
from contentlens.llm.textsets import mix, runs, seeds, signatures, word_hashes

WIDTH, SIMILARITY = 5, 0.8
#: Places of a signature; sets of a bucket that are compared without a further
#: split; children of a set at a split, on average; levels of splits at most (a
#: bucket that is large after that is compared block against block).
PLACES, BUCKET, BRANCH, LEVELS = 64, 128, 2.0, 16
#: Chance that a pair at the threshold meets in at least one bucket.
RECALL = 0.9995
#: Standard deviations below the threshold at which two signatures still look alike.
SLACK = 4.0
#: Sets of a block; larger groups are compared block against block.
BLOCK = 1024
RUN_BYTES = 4 << 20


def survival(similarity: float, branch: float) -> float:
    """Chance that a pair keeps on sharing a child, however often its bucket is split."""
    q = 1.0
    for _ in range(200):
        q = 1 - math.exp(-similarity * branch * q)
    return q


def runs_for(recall: float, similarity: float, branch: float = BRANCH) -> int:
    """Runs after which a pair at the threshold has met with chance ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity * survival(similarity, branch))))


def alike_places(similarity: float, places: int, slack: float = SLACK) -> int:
    """Equal places at which two signatures look alike."""
    return max(1, math.floor(places * similarity - slack * math.sqrt(places * similarity * (1 - similarity))))


def describe(docs: DataFrame, width: int, places: int) -> DataFrame:
    """doc_id, th (hash of the text), sid (digest of the shingle set, of the text
    if it has no words; null for empty texts) and sig (MinHash signature; null
    without words) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in pieces_of(batch, "text", RUN_BYTES):
                grams, at = runs(*word_hashes(rows.column(2)), width)
                sig = signatures(grams, at, places)
                sids = [
                    blake2b(np.unique(grams[a:b]).tobytes(), digest_size=16).digest() if b > a else None
                    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)
                ]
                signed = [r.tobytes() if s else None for r, s in zip(sig, sids, strict=True)]
                for i in [i for i, s in enumerate(sids) if s is None]:
                    if text := rows.column(2)[i].as_py():
                        sids[i] = blake2b(text.encode(), digest_size=16, person=b"no words").digest()
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(sids, pa.binary()), pa.array(signed, pa.binary())],
                    names=["doc_id", "th", "sid", "sig"],
                )

    return docs.mapInArrow(run, "doc_id long, th long, sid binary, sig binary")


def _children(rows: DataFrame, split: bool, repeat: int, places: int, branch: float, seed: int) -> DataFrame:
    """sid, bucket, within (sets of the parent) of the buckets that sets go to: in
    each run at the root, at the sampled places of their ``node`` at a split."""
    first = np.random.default_rng(seed).permutation(places)
    chance = np.uint64(min(1.0, branch / places) * (2**64 - 1))
    steps = np.arange(1, places + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = seeds(repeat, seed)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, places).astype(np.uint64)
            if split:
                node = batch.column(2).to_numpy().view(np.uint64)
                row, place = np.nonzero(mix(node[:, None] + steps[None, :]) < chance)
                node, within = node[row], batch.column(3).to_numpy()[row]
            else:
                row, k = np.repeat(np.arange(n), repeat), np.tile(np.arange(repeat), n)
                place, node, within = first[k % places], starts[k], np.zeros(n * repeat, np.int64)
            bucket = mix(node + mix(sig[row, place] + np.uint64(1)) + place.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(bucket.view(np.int64)), pa.array(within)], names=["sid", "bucket", "within"]
            )

    cols = ["sid", "sig", "node", "within"] if split else ["sid", "sig"]
    return rows.select(*cols).mapInArrow(run, "sid binary, bucket long, within long")


def _buckets(sets: DataFrame, repeat: int, places: int, branch: float, levels: int, bucket: int, seed: int) -> DataFrame:
    """bucket, sid, size: where paths end, without buckets of one set.

    A level is one stored table of (set, bucket).  Sizes are counted with a
    combine before the shuffle; only rows of small buckets are joined to them
    by a shuffle, large buckets are few and known by a list.
    """
    out, keyed = None, stored(_children(sets, False, repeat, places, branch, seed), "level")
    for level in range(levels + 1):
        count = keyed.groupBy("bucket").agg(F.count("*").alias("size"), F.max("within").alias("within"))
        sizes = stored(count.where("size > 1"), "sizes")
        small = sizes.where(F.col("size") <= bucket).select("bucket", "size")
        large = sizes.where(F.col("size") > bucket)
        listed = large.count()
        known = (lambda df: F.broadcast(df)) if listed <= BROADCAST_KEYS else (lambda df: df)
        ends = keyed.select("bucket", "sid")
        if listed:
            ends = ends.join(known(large.select("bucket")), "bucket", "left_anti")
        ends = ends.join(small, "bucket")
        out = ends if out is None else out.unionByName(ends)
        if not listed:
            break
        # dense ones, and what is still large at the last level, are compared as they are
        dense = (2 * F.col("size") >= F.col("within")) & (F.col("within") > 0) | F.lit(level == levels)
        out = out.unionByName(keyed.select("bucket", "sid").join(known(large.where(dense).select("bucket", "size")), "bucket"))
        if level == levels:
            break
        again = keyed.select("sid", "bucket").join(
            known(large.where(~dense).select("bucket", F.col("size").alias("within"))), "bucket"
        ).withColumnRenamed("bucket", "node")
        again = again.join(sets.select("sid", "sig"), "sid")
        keyed = stored(_children(again, True, repeat, places, branch, seed), "level")
    return out


def _blocks(df: DataFrame, group: str, size: str, block: int, seed: int) -> DataFrame:
    """Adds ``task``, ``mine``, ``other``: a group of at most ``block`` sets is one
    task; of a larger one each pair of blocks is one, and a set goes to as
    many tasks as there are blocks."""
    n = F.ceil(F.col(size) / F.lit(float(block))).cast("int")
    own = F.pmod(F.xxhash64("sid", F.lit(seed)), n).cast("int")
    return (
        df.withColumn("mine", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
        .withColumn("task", F.xxhash64(group, F.least("mine", "other"), F.greatest("mine", "other")))
    )


def _in_groups(df: DataFrame, act, schema: str, at_least: int) -> DataFrame:
    """``act`` on whole tasks of rows, many small ones at once."""

    def run(batches):
        return sorted_groups(batches, "task", act, at_least)

    return df.repartition(F.col("task")).sortWithinPartitions("task").mapInArrow(run, schema)


def _bounds(task: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(task)) + 1, [len(task)])).tolist()
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a + 1]


def _spread(near, n: int) -> np.ndarray:
    """Component label of each of n members; ``near(i, rest)`` tells which of rest lie near i."""
    label = np.arange(n)
    rest = np.arange(n)
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        first = todo[0]
        while todo and len(rest):
            hit = near(todo.pop(), rest)
            new = rest[hit]
            label[new] = first
            todo += new.tolist()
            rest = rest[~hit]
    return label


def _alike(buckets: DataFrame, least: int, places: int, block: int) -> DataFrame:
    """Chains (a, b) of sets whose signatures look alike in some bucket."""

    def act(rows: pa.Table) -> pa.Table | None:
        task = rows.column("task").to_numpy()
        sids = rows.column("sid").to_pylist()
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(-1, places)
        a, b = [], []
        for lo, hi in _bounds(task):
            own = sig[lo:hi]
            if hi - lo == 2:
                if int((own[0] == own[1]).sum()) >= least:
                    a.append(sids[lo])
                    b.append(sids[lo + 1])
                continue
            label = _spread(lambda i, rest, own=own: (own[rest] == own[i]).sum(1) >= least, hi - lo)
            for i in np.flatnonzero(label != np.arange(hi - lo)).tolist():
                a.append(sids[lo + label[i]])
                b.append(sids[lo + i])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())}) if a else None

    dealt = _blocks(buckets, "bucket", "size", block, 1).select("task", "sid", "sig")
    return _in_groups(dealt, act, "a binary, b binary", 20_000)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections of sorted sets.

    Shingles held by one set only cannot be common and are dropped; the rest
    are columns of 0/1 matrices that are multiplied a slice at a time.
    """
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.int64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column, total = owner[keep], number[column[keep]], int(shared.sum())
    out = np.zeros((n, n), np.float64)
    step = max(256, (8 << 20) // n)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, total, step):
        a, b = np.searchsorted(column, [lo, lo + step])
        m = np.zeros((n, min(step, total - lo)), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    got = np.rint(out).astype(np.int64)
    np.fill_diagonal(got, [len(s) for s in sets])
    return got


def _verified(families: DataFrame, similarity: float) -> DataFrame:
    """sid, links (rows linked to it within the task) and root (least linked set's sid)."""

    def act(rows: pa.Table) -> pa.Table | None:
        task, sid = rows.column("task").to_numpy(), rows.column("sid").to_pylist()
        mine, other = rows.column("mine").to_numpy(), rows.column("other").to_numpy()
        copies, grams = rows.column("copies").to_numpy(), rows.column("grams").to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        for lo, hi in _bounds(task):
            kept = list({sid[i]: i for i in range(lo, hi)}.values())  # a set can come from several tasks
            if len(kept) < 2:
                continue
            sets = [np.frombuffer(grams[i], np.uint64) for i in kept]
            size = np.array([len(s) for s in sets])
            common = intersections(sets)
            linked = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9
            np.fill_diagonal(linked, False)
            weight, side, across = copies[kept], mine[kept], other[kept]
            if (side != across).any():  # two blocks: only pairs between them are this task's
                linked &= side[:, None] != side[None, :]
            label = _spread(lambda i, rest, linked=linked: linked[i, rest], len(kept))
            links = linked @ weight
            for i in np.flatnonzero(links).tolist():
                out[0].append(sid[kept[i]])
                out[1].append(int(links[i]))
                out[2].append(sid[kept[label[i]]])
        if not out[0]:
            return None
        return pa.table({"sid": pa.array(out[0], pa.binary()), "links": pa.array(out[1], pa.int64()), "root": pa.array(out[2], pa.binary())})

    return _in_groups(families, act, "sid binary, links long, root binary", 2_000)


def _with_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Rows of ``wanted`` with the shingle set of their text; a set that many
    rows hold comes once from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            fresh = []
            for s in batch.column(1).to_pylist():
                fresh.append(s not in seen)
                seen.add(s)
            for rows in pieces_of(batch.filter(pa.array(fresh, pa.bool_())), "text", RUN_BYTES):
                grams, at = runs(*word_hashes(rows.column(0)), width)
                sets = [np.unique(grams[a:b]).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[1:], pa.array(sets, pa.binary())], names=["sid", "family", "size", "copies", "grams"]
                )

    rows = docs.join(
        wanted.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(wanted["first_id"]) & (docs["th"] == wanted["first_th"])
    ).select("text", "sid", "family", "size", "copies")
    return rows.mapInArrow(run, "sid binary, family binary, size long, copies long, grams binary")


def linked_rows(docs: DataFrame, width: int, similarity: float, recall: float, branch: float, bucket: int, block: int, seed: int) -> DataFrame:
    """doc_id, th (hash of the text), root (of the class; null for empty texts),
    class_id, n_links of every row."""
    base = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("th", F.xxhash64("text"))
    rows = stored(describe(base.select("doc_id", "th", "text"), width, PLACES), "described")
    full = rows.where("sid IS NOT NULL")
    sets = stored(
        full.groupBy("sid").agg(
            F.count("*").alias("copies"),
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))).alias("first"),
            F.first("sig").alias("sig"),
        ),
        "sets",
    )
    repeat = min(PLACES, runs_for(recall, similarity, branch))
    worded = sets.where("sig IS NOT NULL").select("sid", "sig")
    buckets = stored(_buckets(worded, repeat, PLACES, branch, LEVELS, bucket, seed), "buckets")
    buckets = buckets.join(worded, "sid")
    chains = stored(_alike(buckets, alike_places(similarity, PLACES), PLACES, block), "chains")
    family = connected_components(chains, "a", "b").select(F.col("vertex").alias("sid"), F.col("root").alias("family"))
    sizes = family.groupBy("family").agg(F.count("*").alias("size"))
    wanted = family.join(sizes, "family").join(sets.drop("sig"), "sid").select(
        "sid", "family", "size", "copies", F.col("first.doc_id").alias("first_id"), F.col("first.th").alias("first_th")
    )
    families = _blocks(_with_sets(base, stored(wanted, "wanted"), width), "family", "size", block, 2)
    links = stored(
        _verified(families.select("task", "sid", "mine", "other", "copies", "grams"), similarity), "links"
    )
    linked = links.groupBy("sid").agg(F.sum("links").alias("links"))
    roots = connected_components(links.where("sid <> root"), "sid", "root")
    classes = sets.select("sid", "copies", F.col("first.doc_id").alias("first_id")).join(
        roots.select(F.col("vertex").alias("sid"), "root"), "sid", "left"
    ).withColumn("root", F.coalesce("root", "sid"))
    least = classes.groupBy("root").agg(F.min("first_id").alias("class_id"))
    known = classes.join(least, "root").join(linked, "sid", "left").select(
        "sid", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return rows.select("doc_id", "th", "sid").join(known, "sid", "left").select(
        "doc_id",
        "th",
        F.coalesce("root", "sid").alias("root"),
        F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def jaccard_classes(
    docs: DataFrame,
    width: int = WIDTH,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    branch: float = BRANCH,
    bucket: int = BUCKET,
    block: int = BLOCK,
    seed: int = 5,
) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``docs``.

    ``n_links`` counts the other rows whose shingle sets have a Jaccard
    similarity of at least ``similarity`` (equal sets included);
    ``class_id`` is the least doc_id of the row's connected class.  A text of
    fewer than ``width`` words is one shingle of all its words.  A text without
    words is linked to equal texts alone.  Empty texts (null texts too) have no
    links and are classes of their own, with their own doc_id.  Null ids count as larger than any.  Repeated rows are
    links of each other.  An empty table gives no rows; further columns are
    not read.
    """
    return linked_rows(docs, width, similarity, recall, branch, bucket, block, seed).select("doc_id", "class_id", "n_links")


def one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: the least id, then the least hash of
    the text; of rows equal in both, one.  Columns stay; an empty text is
    a class of its own."""
    given = {"width": WIDTH, "similarity": SIMILARITY, "recall": RECALL, "branch": BRANCH, "bucket": BUCKET, "block": BLOCK, "seed": 5}
    rows = stored(linked_rows(docs, **(given | options)).where("n_links > 0").select("doc_id", "th", "root"), "linked")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("th"))
    keys = rows.groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    best = keys.groupBy("root").agg(F.min(order).alias("best"))
    keys = stored(keys.join(best, "root").select("doc_id", "th", "n", (order == F.col("best")).alias("kept")), "keys")
    out = without(docs, keys.where("NOT kept"))
    again = keys.where("kept AND n > 1")  # rows that come several times over
    if again.isEmpty():
        return out
    k_id, k_th = free_names(docs, "k_id", "k_th")
    again = again.select(F.col("doc_id").alias(k_id), F.col("th").alias(k_th))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(k_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(k_th))
    once = out.join(again, same, "left_semi")
    once = once.dropDuplicates(["doc_id", "text"])
    return out.join(again, same, "left_anti").unionByName(once)
