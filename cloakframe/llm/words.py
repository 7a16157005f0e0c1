"""Words and their hashes, for whole texts, without an object per word.

Words are maximal runs of bytes other than blank and 0x09-0x0D, in UTF-8. A word's hash is a multilinear sum over
its bytes with a coefficient per position, so that two different words meet with a chance of about 2**-57.
"""

from __future__ import annotations

import numpy as np

WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at a time; a longer word is hashed whole.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def coefficients(n: int, seed: int) -> np.ndarray:
    """Pseudo-random odd numbers, the same on every machine."""
    start = np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    return mix(start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_AT = coefficients(1 << 12, seed=1)


def _at(n: int) -> np.ndarray:
    return _AT if n <= len(_AT) else coefficients(n, seed=1)


def _hash_chunk(data: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
    """``kinds`` of bytes: 0 parts words, and so does a change from one of the others to another."""
    kind = (~SPACE).view(np.uint8)[data] if kinds is None else kinds[data]
    inside = kind > 0
    edge = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    starts = edge[:-1][inside[edge[:-1]]] if len(edge) else edge
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    ends = edge[1:][inside[edge[:-1]]]
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    position = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    terms = (data[inside].astype(np.uint64) + np.uint64(1)) * _at(int(lengths.max()))[position]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))


#: For ``word_hashes``: letters, digits and bytes beyond ASCII are one kind, other visible characters another.
LEXICAL = np.array([0 if SPACE[b] else 1 if b > 127 or chr(b).isalnum() else 2 for b in range(256)], dtype=np.uint8)


def word_hashes(text: bytes, kinds: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the words of ``text`` in order; with ``kinds`` words also end where the kind changes."""
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) <= CHUNK:
        return _hash_chunk(data, kinds)
    blanks, parts, begin = np.flatnonzero(SPACE[data]), [], 0
    while begin < len(data):
        k = np.searchsorted(blanks, begin + CHUNK)
        end = int(blanks[k]) if k < len(blanks) else len(data)
        parts.append(_hash_chunk(data[begin:end], kinds))
        begin = end
    return np.concatenate(parts)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; fewer words make one run of all, no words none."""
    if not len(words):
        return words
    n = min(n, len(words))
    factor = coefficients(n, seed=n + 1)
    rows = len(words) - n + 1
    total = words[:rows] * factor[0]
    for k in range(1, n):
        total += words[k : k + rows] * factor[k]
    return np.unique(mix(total))
