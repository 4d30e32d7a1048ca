"""11. Spelling variants by a bit-sliced position index.

The vocabulary is indexed by one bitset per (position, letter): the words that
have this letter at this place.  A word runs through its letters once and
carries whole sets of vocabulary words: those that agree so far, those with one
letter replaced, those that are one letter shorter (compared with the bitsets
of the place before) and one longer (of the place after).  What is left after
the last letter, cut to the right length, are all words at exactly one error.

One error leaves the first or the last half of two words as it is, so a word
meets only the words that share such a half: ``(length class, side, half)`` is
the bucket.  Small buckets share an index in which a word starts from the bits
of its own bucket; a bucket beyond a block is compared block against block.
A task reports per word the number of near words and the best of them, never
the pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentlens.llm.common import BROADCAST_KEYS, bounded_batches, sorted_groups, stored

LETTERS = "a-zÀ-ÿ"
#: Code points and occurrences that a word needs.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A near word this many times as frequent is the form of a word.
RATIO = 10
#: Words of one index; words and letters of a bucket beyond which it is cut into blocks.
INDEX, BLOCK, BLOCK_LETTERS = 512, 2048, 1 << 20
#: Words and code points that a task counts before it hands them on.
HELD_WORDS, HELD_POINTS = 200_000, 16 << 20


def word_counts(
    docs: DataFrame, letters: str = LETTERS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip_every: int | None = None
) -> DataFrame:
    """(word, n): maximal runs of ``letters`` (a character class without A-Z,
    which are lower-cased) of whole texts, with their number of occurrences.

    With ``slip_every`` slips of the pen are made: where that number divides
    crc32 of ``<doc_id>:<run>``, the run loses the code point at the place crc32
    modulo its length.  A null id counts as an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"[{letters}]{{{max(1, least_length)},}}").findall
        held: Counter[str] = Counter()
        points = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{doc or ''}:".encode())
                for word, n in Counter(find(text.lower().decode())).items():
                    if slip_every:
                        h = zlib.crc32(word.encode(), start)
                        if h % slip_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                    if word not in held:
                        points += len(word)
                    held[word] += n
                if len(held) >= HELD_WORDS or points >= HELD_POINTS:
                    yield out()
                    held.clear()
                    points = 0
        if held:
            yield out()

    # bytes.lower() changes A-Z alone
    base = bounded_batches(docs).select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").cast("binary").alias("text"))
    found = base.where("text IS NOT NULL").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    packed = np.packbits(flags, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def one_error(words: list[str], allowed: np.ndarray) -> np.ndarray:
    """For each word (a row) the set of words (bits of the columns, in the given
    order) that differ from it by exactly one inserted, deleted or replaced code
    point, among those that ``allowed`` (square, without itself) leaves."""
    n = len(words)
    size = np.array([len(w) for w in words])
    longest = int(size.max(initial=0))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, number = np.unique(flat, return_inverse=True)
    at = np.concatenate(([0], np.cumsum(size)))
    letter = np.zeros((n, longest + 2), np.int32)  # 0: the word has ended
    letter[np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(at[:-1], size)] = number + 1
    symbols = np.arange(len(alphabet) + 1)[:, None]

    def index(place: int) -> np.ndarray:
        sets = _bits(letter[None, :, place] == symbols)
        sets[0] = 0
        return sets

    order = np.argsort(size, kind="stable")  # rows by length: those still running are the last ones
    rows = letter[order]
    start = np.searchsorted(size[order], np.arange(longest), side="right")
    same = _bits(allowed[order])
    replaced, shorter, longer = np.zeros_like(same), np.zeros_like(same), np.zeros_like(same)
    before, here, after = np.zeros((len(symbols), same.shape[1]), np.uint64), index(0), index(1)
    for i in range(longest):
        s, x = start[i], rows[start[i] :, i]
        z, hit = same[s:], here[x]
        longer[s:] = (longer[s:] | z) & after[x]
        shorter[s:] = (shorter[s:] & before[x]) | z
        going = np.bitwise_or.reduce(here, axis=0)  # words that have a letter here
        replaced[s:] = (replaced[s:] & hit) | (z & ~hit & going)
        same[s:] = z & hit
        before, here, after = here, after, index(i + 2) if i + 2 < longest + 2 else np.zeros_like(here)
    lengths = _bits(size[None, :] == np.arange(longest + 2)[:, None]) if longest < 4096 else None

    def of_length(m: np.ndarray) -> np.ndarray:
        return lengths[m] if lengths is not None else _bits(size[None, :] == m[:, None])

    m = size[order]
    got = (replaced & of_length(m)) | (shorter & of_length(m - 1)) | ((longer | same) & of_length(m + 1))
    out = np.empty_like(got)
    out[order] = got
    return out


def _near(rows: pa.Table) -> pa.Table | None:
    """word, near, best_n, best of the words of whole tasks that have near words."""
    task, count, cls, side, mine, other = (rows.column(c).to_numpy() for c in ("task", "n", "class", "side", "mine", "other"))
    words = rows.column("word").to_pylist()
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(task)) + 1, [len(task)])).tolist()
    out: tuple[list, list, list, list] = ([], [], [], [])

    def flush(groups: list[tuple[int, int]]) -> None:
        where = np.concatenate([np.arange(a, b) for a, b in groups])
        group = np.repeat(np.arange(len(groups)), [b - a for a, b in groups])
        rank = sorted(range(len(where)), key=lambda i: (-count[where[i]], words[where[i]]))
        where, group = where[rank], group[rank]
        own, c, long_side = [words[i] for i in where], cls[where], side[where] == 1
        size = np.array([len(w) for w in own])
        halves, prefixes = {}, {}
        for w, k, s in zip(own, c.tolist(), side[where].tolist(), strict=True):
            h = k // 2
            halves.setdefault((k, s, w[len(w) - h :] if s else w[:h]), len(halves))
            prefixes.setdefault((k, w[:h]), len(prefixes))
        half = np.array([halves[k, s, w[len(w) - k // 2 :] if s else w[: k // 2]] for w, k, s in zip(own, c.tolist(), side[where].tolist(), strict=True)])
        prefix = np.array([prefixes[k, w[: k // 2]] for w, k in zip(own, c.tolist(), strict=True)])
        block, across, longer = mine[where], (mine != other)[where], size > c
        allowed = (group[:, None] == group[None, :]) & (half[:, None] == half[None, :])
        # met in the bucket of the first half, or of the longer class, already
        allowed &= ~(long_side[:, None] & (prefix[:, None] == prefix[None, :]))
        allowed &= ~(longer[:, None] & longer[None, :])
        allowed &= ~across[:, None] | (block[:, None] != block[None, :])
        np.fill_diagonal(allowed, False)
        found = one_error(own, allowed)
        near = np.bitwise_count(found).sum(1)
        for i in np.flatnonzero(near).tolist():
            best = int(np.unpackbits(found[i : i + 1].view(np.uint8), bitorder="little").argmax())
            out[0].append(own[i])
            out[1].append(int(near[i]))
            out[2].append(int(count[where[best]]))
            out[3].append(own[best])

    groups: list[tuple[int, int]] = []
    held = longest = 0
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a < 2:
            continue
        top = int(cls[a:b].max()) + 1
        if groups and (held + b - a > INDEX or (held + b - a) * max(longest, top) > BLOCK_LETTERS):
            flush(groups)
            groups, held, longest = [], 0, 0
        groups.append((a, b))
        held, longest = held + b - a, max(longest, top)
    if groups:
        flush(groups)
    if not out[0]:
        return None
    return pa.table([pa.array(out[0], pa.string()), *[pa.array(out[k], pa.int64()) for k in (1, 2)], pa.array(out[3], pa.string())], names=["word", "near", "best_n", "best"])


def near_words(vocabulary: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n_near, best_n, best of the words of ``vocabulary`` (word, n; stored,
    words distinct) that have near words in it."""
    length = F.char_length("word")
    keys = []
    for c in (length, length - 1):
        half = F.floor(c / 2).cast("int")
        for side in (0, 1):
            text = F.substring(F.col("word"), length - half + 1 if side else F.lit(1), half)
            keys.append(F.struct(c.cast("int").alias("class"), F.lit(side).alias("side"), F.xxhash64(c, F.lit(side), text).alias("key")))
    rows = vocabulary.select("word", "n", F.explode(F.array(*keys)).alias("k")).select("word", "n", "k.*")
    rows = rows.where(F.col("class") >= max(1, least_length))
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("size") * F.col("top") / BLOCK_LETTERS)).cast("int")
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.max("class").alias("top"))
    large = stored(sizes.select("key", blocks.alias("blocks")).where("blocks > 1"), "large-buckets")
    large = F.broadcast(large) if large.count() <= BROADCAST_KEYS else large
    several = F.coalesce("blocks", F.lit(1))
    dealt = (
        rows.join(large, "key", "left")
        .withColumn("mine", F.pmod(F.xxhash64("word"), several).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), several - 1)))
        .withColumn("task", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
        .select("task", "word", "n", "class", "side", "mine", "other")
    )

    def run(batches):
        return sorted_groups(batches, "task", _near, 20_000)

    found = dealt.repartition(F.col("task")).sortWithinPartitions("task").mapInArrow(run, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best")
    )


def spelling_variants(vocabulary: DataFrame, least_length: int = LEAST_LENGTH, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``vocabulary`` (word,
    n; distinct words of at least ``least_length`` code points).

    Words are near if they differ by exactly one inserted, deleted or replaced
    code point.  The form of a word is its most frequent near word (ties: the
    smallest in code-point order) if that is at least ``ratio`` times as
    frequent, else null; the root is the last form on the way from word to form
    to its form, the word itself if it has none.  Each step multiplies the
    count, so the ways end, and they are followed by doubling.  An empty
    vocabulary gives no rows; null words take no part; other columns are not read.
    """
    vocabulary = stored(vocabulary.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    near = near_words(vocabulary, least_length)
    all_ = stored(
        vocabulary.join(near, "word", "left")
        .withColumn("ok", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False)))
        .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.expr("IF(ok, best, NULL)").alias("form"), F.expr("IF(ok, best_n, NULL)").alias("form_n")),
        "forms",
    )
    ways = all_.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
    while True:
        on = ways.select(F.col("word").alias("to"), F.col("to").alias("further"))
        ways = stored(ways.join(on, "to", "left").select("word", F.coalesce("further", "to").alias("to"), "further"), "ways")
        if ways.where("further IS NOT NULL").isEmpty():
            break
        ways = ways.drop("further")
    return all_.join(ways.select("word", "to"), "word", "left").select(
        "word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n"
    )


def variants_of_documents(docs: DataFrame, slip_every: int | None = None, **options) -> DataFrame:
    """:func:`spelling_variants` of the words of whole texts (columns doc_id,
    text; null texts have no words, repeated rows count again)."""
    return spelling_variants(word_counts(docs, slip_every=slip_every), **options)
