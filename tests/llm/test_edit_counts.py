"""8. Counts after edits against counting the edited text anew."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from contentlens.llm.edit_counts import CountTree, apply_edits, build_trees, count_trees, counts_after_edits, edit_round, leaves, routine_edits
from contentlens.llm.tokens import encoder

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = st.text(alphabet=st.sampled_from("abé \n.,'s1\t́"), max_size=60)


def count(path, text):
    return len(encoder(path).whole.encode(text, add_special_tokens=False).ids)


@settings(max_examples=120, deadline=None)
@given(TEXTS, st.lists(st.tuples(st.integers(-3, 2000), st.integers(-3, 2000), TEXTS), max_size=6), st.sampled_from([WORDS, BYTES]), st.integers(1, 25))
def test_edits_equal_counting_anew(text, edits, path, times):
    text = text * times
    coder = encoder(path)
    texts, trees, want = [text], build_trees(coder, [text]), text
    for start, stop, new in edits:
        edit_round(coder, texts, trees, [(0, start, stop, new)])
        start = min(max(0, start), len(want))
        want = want[:start] + new + want[min(max(start, stop), len(want)) :]
        assert texts[0] == want
        assert int(trees[0].chars[1]) == len(want) and int(trees[0].tokens[1]) == count(path, want)


@given(st.text(alphabet="ab \n", max_size=3000))
def test_leaves_cover(text):
    assert "".join(leaves(text, 16)) == text


def test_tree_find_and_put():
    tree = CountTree.build([3, 0, 5, 2, 1], [1, 0, 2, 1, 1])
    assert [tree.find(i)[0] for i in range(11)] == [0, 0, 0, 2, 2, 2, 2, 2, 3, 3, 4]
    tree.put(2, 7, 9)
    assert tree.chars[1] == 13 and tree.tokens[1] == 12 and tree.find(9) == (2, 3)


ROWS = [(1, None), (2, ""), (3, "short"), (4, "some words, that repeat. " * 2000), (5, "z" * 3000), (6, "twice"), (6, "twice"), (None, "no id " * 90)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(d, t, "src", "en", [1], [2]) for d, t in rows], "doc_id long, text string, source string, lang string, chars array<int>, tokens array<int>")


def edited(text):
    text = text or ""
    new = "src: en\n" + text
    half = len(text) // 2 + 8
    new = new[:half] + text[len(text) // 2 :][:64].upper() + new[half + 64 :]
    return new[: max(0, len(text) + 8 - 16)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_frames(spark, path):
    got = counts_after_edits(frame(spark), routine_edits(), path).collect()
    want = sorted(((d, len(t or ""), count(path, t or ""), len(edited(t)), count(path, edited(t))) for d, t in ROWS), key=str)
    assert sorted(((r.doc_id, r.n_chars, r.n_tokens, r.edited_chars, r.edited_tokens) for r in got), key=str) == want
    long = next(r for r in got if r.doc_id == 4)
    assert long.reencoded < 0.1 * long.n_chars
    assert counts_after_edits(frame(spark, []), routine_edits(), path).count() == 0


def test_state_lives_on(spark):
    state = count_trees(frame(spark), WORDS)
    one = F.array(F.struct(F.lit(2).cast("long").alias("start"), F.lit(4).cast("long").alias("stop"), F.lit("new words").alias("text")))
    rows = apply_edits(apply_edits(state, one, WORDS).drop("reencoded"), one, WORDS).collect()
    for r, (_, t) in zip(sorted(rows, key=lambda r: str((r.doc_id, r.text))), sorted(ROWS, key=lambda r: str((r[0], r[1] or ""))), strict=True):
        want = t or ""
        for _ in range(2):
            want = want[:2] + "new words" + want[4:]
        assert r.text == want and r.tokens[1] == count(WORDS, want) and r.chars[1] == len(want)


def test_null_edits(spark):
    none = F.lit(None)
    got = counts_after_edits(frame(spark), none, WORDS).collect()
    assert all(r.edited_tokens == r.n_tokens and r.reencoded == 0 for r in got)
