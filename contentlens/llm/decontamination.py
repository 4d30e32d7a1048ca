"""4. Benchmark decontamination: MinHash containment search, parted by size.

Items and documents are sets of word shingles.  An item's sketch holds its
least shingles under a random order (bottom-k MinHash).  Items are parted by
size class; a class takes as many shingles into its sketches as make a
document that holds the wanted share of any of its items hit at least one of
them, so the search loses nothing.  Documents that hit an item's sketch often
enough are candidates; the exact containment of all its shingles decides.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentlens.llm.common import WORD_SPLIT, stored, without

#: Words of a shingle; share of an item's shingles that makes a document contaminated.
WIDTH, SHARE = 5, 0.8
#: The sketch table is broadcast up to so many rows of four numbers (32 bytes
#: each, 6 MB in all) and joined by shuffles beyond, with the same result.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_SPLIT), lambda w: w != "")


def shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of ``width`` words, in order (empty if there are fewer)."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(n >= width, runs).otherwise(F.expr("array()").cast("array<bigint>"))


def item_shingles(items: DataFrame, width: int) -> DataFrame:
    """item_id, ih (hash of the item's words), width, shingle (distinct), size.
    An item is its id with its words: different texts with one id (or without
    one) are items of their own.  An item of fewer words than ``width`` is one
    shingle of all its words; one without words has none."""
    w = items.select("item_id", words(F.col("text")).alias("w")).withColumn("width", F.least(F.size("w"), F.lit(width)))
    w = w.withColumn("ih", F.xxhash64("w"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1), lambda i: F.xxhash64(F.slice("w", i, F.col("width"))))
    rows = w.where("width > 0").select("item_id", "ih", "width", F.explode(runs).alias("shingle")).distinct()
    return rows.withColumn("size", F.count("*").over(Window.partitionBy("item_id", "ih", "width")))


def sketches(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """item_id, ih, width, shingle, need: each item's least shingles by seeded hash.

    In the class of sizes 2^k..2^(k+1)-1 a sketch holds u - ceil(share u) + 1
    shingles, u the largest size of the class.  An item of size s that lies in
    a document by the wanted share misses at most s - ceil(share s) of its
    shingles, so at least ``need`` of its sketch occur there.
    """
    top = F.pow(F.lit(2.0), F.floor(F.log2(F.col("size").cast("double"))) + 1) - 1
    take = top - F.ceil(top * share - 1e-9) + 1
    order = Window.partitionBy("item_id", "ih", "width").orderBy(F.xxhash64("shingle", F.lit(seed)), "shingle")
    held = F.least(take, F.col("size").cast("double"))
    need = F.greatest(held - (F.col("size") - F.ceil(F.col("size") * share - 1e-9)), F.lit(1.0))
    return (
        rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)
        .select("item_id", "ih", "width", "shingle", need.cast("long").alias("need"))
    )


def matches(docs: DataFrame, items: DataFrame, width: int, share: float, seed: int) -> DataFrame:
    """doc_id, th (hash of the text), item_id, ih (hash of the item's words), n_shingles, n_shared."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    base = base.withColumn("th", F.xxhash64("text"))
    bench = stored(item_shingles(items.select(F.col("item_id"), F.col("text").cast("string").alias("text")), width), "bench")
    widths = sorted(r[0] for r in bench.select("width").distinct().collect())  # at most ``width`` numbers
    sketch = stored(sketches(bench, share, seed), "sketch")
    small = sketch.count() <= BROADCAST_ROWS

    def hits(of: DataFrame, table: DataFrame) -> DataFrame:
        held = of.select("doc_id", "th", words(F.col("text")).alias("w"))
        out = None
        for k in widths or [width]:
            each = held.select("doc_id", "th", F.explode(shingles(F.col("w"), k)).alias("shingle"))
            own = table.where(F.col("width") == k).drop("width")
            got = each.join(F.broadcast(own) if small else own, "shingle").withColumn("width", F.lit(k))
            out = got if out is None else out.unionByName(got)
        return out

    found = (
        hits(base, sketch).groupBy("doc_id", "th", "item_id", "ih", "width")
        .agg(F.count_distinct("shingle").alias("hits"), F.first("need").alias("need"))
        .where("hits >= need").select("doc_id", "th", "item_id", "ih", "width")
    )
    found = stored(found, "candidates")
    few = found.select(F.col("doc_id").alias("c_doc"), F.col("th").alias("c_th")).distinct()
    again = base.join(few, base["doc_id"].eqNullSafe(few["c_doc"]) & (base["th"] == few["c_th"]), "left_semi")
    exact = (
        again.dropDuplicates(["doc_id", "th"])
        .select("doc_id", "th", words(F.col("text")).alias("w"))
    )
    out = None
    for k in widths or [width]:
        each = exact.select("doc_id", "th", F.explode(F.array_distinct(shingles(F.col("w"), k))).alias("shingle"))
        got = each.join(bench.where(F.col("width") == k).drop("width"), "shingle").withColumn("width", F.lit(k))
        out = got if out is None else out.unionByName(got)
    counted = out.groupBy("doc_id", "th", "item_id", "ih", "width").agg(F.count("*").alias("n_shared"), F.first("size").alias("n_shingles"))
    return counted.where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * share - 1e-9))


def contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE, seed: int = 4) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment: every document and
    item with at least ``share`` of the item's distinct shingles in the document.

    Words are runs of letters, marks and digits, in lower case.  Null texts
    are empty and match nothing.  Rows of ``docs`` with one id and equal texts
    give their matches once; with one id and different texts, each text is
    searched and the largest count is kept.  Rows of ``items`` with one id and
    equal words are one item; with one id, or none, and different words, each
    is an item with a size, search and row of its own, so an id can occur in
    several rows of a document.  Null ids are kept as null.  Empty tables give
    no rows; further columns are not read.
    """
    return (
        matches(docs, items, width, share, seed)
        .groupBy("doc_id", "item_id", "ih", "n_shingles").agg(F.max("n_shared").alias("n_shared"))
        .select("doc_id", "item_id", "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))
    )


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE, seed: int = 4) -> DataFrame:
    """Rows of ``docs`` whose text holds no item; columns unchanged."""
    return without(docs, stored(matches(docs, items, width, share, seed).select("doc_id", "th"), "contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
i AS (SELECT item_id, len(w) AS n, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 5, 0) + 2),
      lambda x: array_to_string(w[x:x + least(len(w), 5) - 1], ' ')))) AS g FROM b WHERE len(w) > 0),
s AS (SELECT item_id, least(n, 5) AS k, g, count(*) OVER (PARTITION BY item_id) AS size FROM i),
k AS (SELECT DISTINCT k FROM s),
e AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda x: array_to_string(w[x:x + k - 1], ' '))) AS g
      FROM d, k WHERE len(w) >= k),
c AS (SELECT doc_id, item_id, size AS n_shingles, count(*) AS n_shared FROM e JOIN s USING (k, g) GROUP BY ALL)
SELECT *, n_shared / n_shingles AS containment FROM c WHERE n_shared >= ceil(n_shingles * 0.8 - 1e-9)
"""
