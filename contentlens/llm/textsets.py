"""Words, word shingles and MinHash signatures of text columns, as arrays.

A word is a run of ASCII letters and digits or of characters beyond ASCII, in
lower case; other ASCII characters part words.  Words and shingles are 64-bit
hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_TABLE = np.array([c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(index, offsets, distinct): word i of text t is
    ``distinct[index[offsets[t] + i]]``.  Null texts have no words."""
    low = pc.utf8_lower(texts.fill_null(""))
    if not len(low):
        return np.zeros(0, np.int32), np.zeros(1, np.int64), []
    _, ends, data = low.buffers()
    signs = _TABLE[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    plain = pa.StringArray.from_buffers(len(low), ends, pa.py_buffer(signs), offset=low.offset)
    split = pc.split_pattern(plain, " ")
    at = split.offsets.to_numpy().astype(np.int64)
    at -= at[0]
    coded = split.flatten().dictionary_encode()
    index, distinct = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist()
    if b"" in distinct:
        real = index != distinct.index(b"")
        at = np.concatenate(([0], np.cumsum(real)))[at]
        index = index[real]
    return index, at, distinct


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    index, at, distinct = words(texts)
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return table[index], at


def runs(hashes: np.ndarray, at: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words.  A text with fewer words is one
    run of all its words if ``short``, else it has none; no words, no runs."""
    n = np.diff(at)
    count = np.maximum(n - width + 1, 0)
    ends = np.concatenate(([0], np.cumsum(count)))
    first = np.repeat(at[:-1] - ends[:-1], count) + np.arange(ends[-1])
    with np.errstate(over="ignore"):
        out = mix(hashes[first] + np.uint64(width)) if len(first) else np.zeros(0, np.uint64)
        for k in range(1, width):
            out = mix(out + hashes[first + k])
    few = np.flatnonzero((n > 0) & (n < width)) if short else []
    if len(few):
        extra = np.array([xxhash.xxh3_64_intdigest(hashes[at[i] : at[i + 1]].tobytes()) for i in few], np.uint64)
        out = np.insert(out, ends[few], extra)
        count[few] = 1
        ends = np.concatenate(([0], np.cumsum(count)))
    return out, ends


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _M2 + np.uint64(seed)) | np.uint64(1)


def signatures(hashes: np.ndarray, at: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """MinHash: for each text the least value of each of ``size`` hash
    functions over its runs (uint32); texts without runs get the largest value."""
    out = np.full((len(at) - 1, size), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        starts = at[:-1][full]
        for k, a in enumerate(seeds(size, seed)):
            out[full, k] = np.minimum.reduceat(((hashes * a) >> np.uint64(32)).astype(np.uint32), starts)
    return out
