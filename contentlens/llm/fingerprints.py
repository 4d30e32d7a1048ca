"""10. Document fingerprints: a Merkle tree over sections, paragraphs and spans.

Blank lines part sections, line ends part paragraphs, and a paragraph's words
are cut into spans.  A paragraph's hash is the SHA-256 of its text, a section's
that of its paragraphs' hashes, the root's that of the sections' hashes and of
the blanks in the lines between them: equal roots mean equal texts.  Where two
trees differ, the differing branches lead to the edited paragraphs and spans.

A span ends after a word whose own hash says so (one word in CUT), so words put
in or taken out elsewhere leave it as it is, wherever it moves.  A stretch of
LONGEST words without such a word is cut by count, from where it begins.  A
paragraph of few words has one span for each pair of neighbours or each word.

A fingerprint is the root (64 hex digits), ":", and 8 hex digits for each span.
Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contentlens.llm.common import stored

#: Words of a paragraph whose words are spans; of one that is cut into pairs; one
#: word in CUT ends a span; words of a span at most.
SINGLE, FEW, CUT, LONGEST = 6, 16, 4, 8
BLANK_LINE = r"\n([ \t]*)\n"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(words: Column) -> Column:
    """Hashes of the spans of a paragraph, given its words (one at least)."""
    n = F.size(words)
    single = F.transform(words, lambda w: F.xxhash64(w))
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1))
    )

    def ends(i: Column) -> Column:
        word = F.get(words, i)
        # a word that comes again and again is not cut from itself
        return (F.pmod(F.xxhash64(word), F.lit(CUT)) == 0) & ~word.eqNullSafe(F.get(words, i + 1)) | (i == n - 1)

    def pieces(first: Column, last: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor((last - first) / LONGEST).cast("int")),
            lambda k: F.xxhash64(k, F.slice(words, first + k * LONGEST + 1, F.least(F.lit(LONGEST), last - first + 1 - k * LONGEST))),
        )

    cut = _let(
        F.filter(F.sequence(F.lit(0), n - 1), ends),
        lambda at: F.flatten(F.transform(at, lambda last, k: pieces(F.when(k == 0, 0).otherwise(F.get(at, k - 1) + 1), last))),
    )
    return F.when(n <= SINGLE, single).when(n <= FEW, pairs).otherwise(cut)


def tree(text: Column) -> Column:
    """sections: array of array of paragraphs (hash, spans); blanks: what stands
    in the lines between sections.  A null text is empty."""
    text = F.coalesce(text, F.lit(""))
    sections = F.transform(
        F.split(text, BLANK_LINE),
        lambda s: F.transform(
            F.split(s, "\n"),
            lambda p: F.struct(F.sha2(p.cast("binary"), 256).alias("hash"), _let(F.split(p, " "), spans).alias("spans")),
        ),
    )
    return F.struct(sections.alias("sections"), F.regexp_extract_all(text, F.lit(BLANK_LINE), F.lit(1)).alias("blanks"))


def section_hash(paragraphs: Column) -> Column:
    return F.sha2(F.array_join(F.transform(paragraphs, lambda p: p["hash"]), ",").cast("binary"), 256)


def root(nodes: Column) -> Column:
    """Hash over the hashes of sections and the blanks between them."""
    inner = F.array_join(F.transform(nodes["sections"], section_hash), ",")
    return F.sha2(F.concat_ws(";", inner, F.array_join(nodes["blanks"], ",")).cast("binary"), 256)


def leaves(nodes: Column) -> Column:
    """The 32 low bits of each span hash, in order, as a fingerprint holds them."""
    found = F.flatten(F.flatten(F.transform(nodes["sections"], lambda s: F.transform(s, lambda p: p["spans"]))))
    return F.transform(found, lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF)))


def fingerprint(root_hash: Column, leaf_list: Column) -> Column:
    hexes = F.transform(leaf_list, lambda h: F.lpad(F.hex(h), 8, "0"))
    return F.concat(root_hash, F.lit(":"), F.array_join(hexes, ""))


def numbered(leaf_list: Column) -> Column:
    """The leaves as a set: a leaf that comes again is told apart by its number
    (equal ones stand together after a sort)."""

    def members(h: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda k: (k == 0) | (F.get(h, k) != F.get(h, k - 1)))

        def run(first: Column, j: Column, at: Column) -> Column:
            end = F.coalesce(F.get(at, j + 1), F.size(h))
            return F.transform(F.sequence(F.lit(0), end - first - 1), lambda k: F.get(h, first) * 1_000_003 + k)

        return _let(starts, lambda at: F.flatten(F.transform(at, lambda first, j: run(first, j, at))))

    return _let(F.array_sort(leaf_list), members)


def likeness(root_a: Column, set_a: Column, root_b: Column, set_b: Column) -> Column:
    """Dice coefficient of two sets of :func:`numbered` spans: 1 for equal roots,
    0 for nothing in common."""
    common = F.size(F.array_intersect(set_a, set_b)) * F.lit(2.0)
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(common / (F.size(set_a) + F.size(set_b)))


def fingerprint_likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints as strings (the same number as :func:`likeness`)."""

    def parts(fp):
        return numbered(
            F.transform(
                F.sequence(F.lit(0), ((F.length(fp) - 65) / 8).cast("int") - 1),
                lambda i: F.conv(F.substring(fp, F.lit(66) + i * 8, F.lit(8)), 16, 10).cast("long"),
            )
        )

    return likeness(F.substring(a, 1, 64), parts(a), F.substring(b, 1, 64), parts(b))


def nodes(docs: DataFrame) -> DataFrame:
    """One row per paragraph: doc_id, section, paragraph, section_hash,
    paragraph_hash, spans.  Comparing these from the top finds an edit."""
    return (
        docs.select(F.col("doc_id"), tree(F.col("text")).alias("t"))
        .select("doc_id", F.posexplode("t.sections").alias("section", "s"))
        .withColumn("section_hash", section_hash(F.col("s")))
        .select("doc_id", "section", "section_hash", F.posexplode("s").alias("paragraph", "p"))
        .select("doc_id", "section", "paragraph", "section_hash", F.col("p.hash").alias("paragraph_hash"), F.col("p.spans").alias("spans"))
    )


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paragraphs of ``a`` (rows of :func:`nodes`) that ``b`` has not in the
    same document, with the section they lie in: the edited places."""
    keys = ["doc_id", "paragraph_hash"]
    return a.join(b.select(*keys), keys, "left_anti").select("doc_id", "section", "paragraph")


def differing_spans(a: DataFrame, b: DataFrame) -> DataFrame:
    """The spans inside the differing paragraphs of ``a`` that ``b`` has nowhere
    in the same document: doc_id, section, paragraph, span (from 0)."""
    keys = ["doc_id", "section", "paragraph"]
    edited = a.join(differing(a, b), keys, "left_semi").select(*keys, F.posexplode("spans").alias("span", "hash"))
    return edited.join(b.select("doc_id", F.explode("spans").alias("hash")), ["doc_id", "hash"], "left_anti").select(*keys, "span")


def _next_keys(keys: DataFrame) -> DataFrame:
    """doc_id, th, n and the key that follows in descending order (cyclic).

    Keys are dealt into ranges; within a range the next key is a window
    function away, at its end it is the head of the next range (one row for
    each range).
    """
    ranged = stored(
        keys.repartitionByRange(F.col("doc_id").desc_nulls_last(), F.col("th").desc()).withColumn("range", F.spark_partition_id()),
        "ranges",
    )
    inside = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), F.col("th").desc())
    heads = ranged.groupBy("range").agg(F.max(F.struct(F.col("doc_id"), F.col("th"))).alias("head"))
    along = Window.orderBy("range")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("range", F.coalesce(F.lead("head").over(along), F.first("head").over(whole)).alias("after"))
    rows = ranged.withColumn("next", F.lead(F.struct("doc_id", "th")).over(inside))
    # one row for each range: bounded by the number of partitions
    rows = rows.join(F.broadcast(heads), "range").withColumn("next", F.coalesce("next", "after"))
    return rows.select("doc_id", "th", "n", F.col("next.doc_id").alias("next_id"), F.col("next.th").alias("next_th"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next for every row.

    The edited text has the last floor(n_chars / 3) code points replaced by
    the first as many (or all) of the next document in descending doc_id
    (after the last: the first).  Null texts are empty; null ids come last.
    Rows with one id follow each other in descending order of their text's
    hash; equal rows count as one place in that order and give equal results.
    A lone document is its own next.  An empty table gives no rows; further
    columns are not read.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    base = base.withColumn("th", F.xxhash64("text"))
    keys = base.select("doc_id", "th", F.length("text").alias("n")).distinct()
    links = stored(_next_keys(keys), "next")

    def key(name: str, id_col: str, th_col: str) -> list[Column]:
        """Three columns without nulls, so one exchange serves a grouping and a join."""
        none = F.col(id_col).isNull()
        return [F.coalesce(id_col, F.lit(0).cast("long")).alias(f"{name}1"), none.alias(f"{name}2"), F.col(th_col).alias(f"{name}3")]

    own, to = ["k1", "k2", "k3"], ["t1", "t2", "t3"]
    before = links.select(
        *key("k", "next_id", "next_th"), *key("t", "doc_id", "th"), F.floor(F.col("n") / 3).cast("int").alias("to_cut")
    )
    # both joins take the same columns of the documents, so they share one exchange of the texts
    base = base.select("text", *key("k", "doc_id", "th"))
    doc_id = F.when(~F.col("k2"), F.col("k1")).alias("doc_id")
    rows = base.join(before.hint("shuffle_hash"), own)
    sent = (
        rows.select(*to, F.col("text").substr(F.lit(1), F.col("to_cut")).alias("head"), tree(F.col("text")).alias("t"))
        .select(*to, "head", root(F.col("t")).alias("next_root"), numbered(leaves(F.col("t"))).alias("next_set"))
        .groupBy(*to)
        .agg(F.first("head").alias("head"), F.first("next_root").alias("next_root"), F.first("next_set").alias("next_set"))
        .withColumnsRenamed(dict(zip(to, own, strict=True)))
    )
    n = F.length("text")
    edited = F.concat(F.col("text").substr(F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head"))
    return (
        base.join(sent, own)
        .select(doc_id, n.cast("long").alias("n_chars"), edited.alias("edited"), tree(F.col("text")).alias("t"), "next_root", "next_set")
        .select("*", tree(F.col("edited")).alias("e"))
        .select(
            "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "next_root", "next_set",
            root(F.col("t")).alias("r"), leaves(F.col("t")).alias("l"), root(F.col("e")).alias("er"), leaves(F.col("e")).alias("el"),
        )
        .select("*", numbered(F.col("l")).alias("ls"), numbered(F.col("el")).alias("els"))
        .select(
            "doc_id", "n_chars", "edited_sha256",
            fingerprint(F.col("r"), F.col("l")).alias("fingerprint"),
            fingerprint(F.col("er"), F.col("el")).alias("edited_fingerprint"),
            likeness(F.col("r"), F.col("ls"), F.col("er"), F.col("els")).alias("near_edited"),
            likeness(F.col("r"), F.col("ls"), F.col("next_root"), F.col("next_set")).alias("near_next"),
        )
    )
