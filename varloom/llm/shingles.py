"""Word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def salt(n: int) -> np.uint64:
    return mix(np.array([0x9E3779B97F4A7C15 * (n + 1) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """Per text (null: no words) the 64-bit hashes of its words, in order. Words: what ASCII white space sets apart."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = pc.dictionary_encode(lists.flatten())
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    distinct = flat.dictionary.to_pylist()
    unique = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in distinct), np.uint64, len(distinct))
    keep = np.fromiter(map(bool, distinct), bool, len(distinct))
    code = flat.indices.to_numpy()
    h, ok = (unique[code], keep[code]) if len(code) else (np.zeros(0, np.uint64), np.zeros(0, bool))
    off = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists.offsets) else 0)
    return [h[a:b] if ok[a:b].all() else h[a:b][ok[a:b]] for a, b in zip(off[:-1], off[1:])]


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of the windows of `size` words, in order; a shorter text is one window, one without words none."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, size)
    acc = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        acc = mix(acc * np.uint64(0x100000001B3) + words[i : n - k + 1 + i] + np.uint64(i + 1))
    return acc


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes, how often each stands there)."""
    return np.unique(hashes, return_counts=True)


def repeats_apart(hashes: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The hash of the nth of equal elements, from 0; the first keeps its own."""
    return np.where(nth == 0, hashes, mix(hashes ^ mix(nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))))


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted hashes of the shingles, equal ones told apart by their number: a set whose size is the weighted set's weight."""
    h, n = counted(shingles(words, size))
    if len(h) and n.max() > 1:
        src = np.repeat(np.arange(len(h)), n)
        h = np.sort(repeats_apart(h[src], np.arange(len(src)) - np.repeat(np.cumsum(n) - n, n)))
    return h
