"""Token ids of whole text columns, with the ``tokenizers`` library.

A tokenizer that drops white space gives a text the ids of its words in
order, and web text repeats its words.  So a column is cut at blanks into
words, every distinct word is encoded once by the library, and the ids are
put together with array operations.  For a tokenizer that keeps white space
whole texts go to the library.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept in a worker's memory; beyond that the memory starts anew.
MEMORY_WORDS = 400_000
#: Bytes of text encoded at once.
RUN_BYTES = 4 << 20

#: Signs that may follow a word's letters as one pre-token.
_SIGNS = ".,;:!?*#%&$|/()-"
#: Words of letters below this one (and not the dotted capital I) are lower-cased
#: and composed by Python as by the library's normalizer.
_LATIN_END, _DOTTED = "\u0250", "\u0130"


class _Alphabet(dict):
    """The byte-level letters of a character, as the pre-tokenizer writes them."""

    def __init__(self, pre_tokenizer):
        super().__init__()
        self.of = pre_tokenizer.pre_tokenize_str

    def __missing__(self, code: int) -> str:
        got = self[code] = self.of(chr(code))[0][0]
        return got


class TextEncoder:
    """``encode(texts)`` gives (ids, offsets): the ids of text i are
    ``ids[offsets[i]:offsets[i + 1]]``.  Null texts are empty."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        probe = "ab, c\nd  é."
        self.by_word = self._ids(probe) == b"".join(self._ids(w) for w in probe.replace("\n", " ").split(" "))
        self.fast = self.by_word and array("I").itemsize == 4 and sys.byteorder == "little" and self._part_table()

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part_table(self) -> bool:
        """Whether letters and the signs after them are two pre-tokens of a
        lower-cased word, which the model can take one by one."""
        try:
            self.table = _Alphabet(self.whole.pre_tokenizer)
            probe = ["abc", "Abc,", "été.", "Straße!!", "ŒUVRE***", "()", "x"]
            self._learn_fast(probe)
            return all(self.words.pop(w) == self._ids(w) for w in probe)
        except Exception:  # a tokenizer without these parts: whole words go to the library
            return False

    def _part(self, part: str) -> bytes:
        if len(self.parts) >= MEMORY_WORDS:
            self.parts.clear()
        got = self.parts[part] = array("I", [t.id for t in self.model.tokenize(part.translate(self.table))]).tobytes()
        return got

    def _learn_fast(self, words: list[str]) -> None:
        known, parts = self.words, self.parts
        for word in words:
            core = word.rstrip(_SIGNS)
            if core and not (core.isalpha() and (core.isascii() or (max(core) < _LATIN_END and _DOTTED not in core))):
                known[word] = self._ids(word)
                continue
            low = core.lower()
            ids = (parts.get(low) or self._part(low)) if core else b""
            if len(core) < len(word):
                tail = word[len(core) :]
                ids += parts.get(tail) or self._part(tail)
            known[word] = ids

    def _learn(self, words: list[str]) -> None:
        if self.fast:
            self._learn_fast(words)
        else:
            for word in words:
                self.words[word] = self._ids(word)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.fill_null("")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        if self.by_word:
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
            first = split.offsets.to_numpy().astype(np.int64)
            coded = split.flatten().dictionary_encode()
            index, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            first = first - first[0]
        else:
            index, distinct = np.arange(len(texts)), None
            first = np.arange(len(texts) + 1)
        if distinct is None:
            blobs = [self._ids(t) for t in texts.to_pylist()]
        else:
            if len(self.words) + len(distinct) > MEMORY_WORDS:
                self.words.clear()
            known = self.words
            if missing := [w for w in distinct if w not in known]:
                self._learn(missing)
            blobs = [known[w] for w in distinct]
        flat = np.frombuffer(b"".join(blobs), "<u4")
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
        each = sizes[index]
        ends = np.cumsum(each)
        before = np.concatenate(([0], ends))
        ids = flat[np.repeat(starts[index] - before[:-1], each) + np.arange(int(before[-1]))]
        return ids, before[first]


@lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process."""
    return TextEncoder(path)


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append the id ``end`` to every text."""
    return np.insert(ids, offsets[1:], np.uint32(end)), offsets + np.arange(len(offsets))


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
