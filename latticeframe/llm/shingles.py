"""Words and five-word shingles of many texts at once, as 64-bit hashes in NumPy.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. These separators are ASCII, so the
work is done on UTF-8 bytes. A word's hash is a polynomial over a fixed table of random byte
values modulo 2**64, then mixed; a shingle's hash combines the hashes of its words. Two different
shingles of text that isn't made to collide share a hash with a chance of about 2**-60, which is
the only inexactness here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_POS = _RNG.integers(1, 2**63, 8, dtype=np.uint64) * U64(2) + U64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 3
_BASE_INVERSE = pow(_BASE, -1, 2**64)
#: Bytes handled at a time; a longer text is handled alone, whole.
CHUNK = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (splitmix64's finaliser)."""
    x = x.copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        out = []
        for base in (_BASE, _BASE_INVERSE):
            p = np.full(size, U64(base), dtype=np.uint64)
            p[0] = U64(1)
            out.append(np.multiply.accumulate(p))
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the number of its words."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buf) and not space[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    up, down = _powers(len(buf) + 1)
    acc = np.empty(len(buf) + 1, np.uint64)
    acc[0] = 0
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=acc[1:])
    words = mix((acc[end] - acc[start]) * down[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(start, ends, "left")
    return words, np.diff(upto, prepend=0)


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[np.ndarray]:
    """For each text, in order, the sorted distinct hashes of its shingles."""
    for a, b in _chunks(texts):
        words, counts = word_hashes(texts[a:b])
        grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            grams += words[k : k + len(grams)] * _POS[k]
        grams = mix(grams)
        at = 0
        for n in counts.tolist():
            if n >= width:
                own = np.sort(grams[at : at + n - width + 1])
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield own[keep]
            elif n:
                whole = (words[at : at + n] * _POS[:n]).sum(dtype=np.uint64) + U64(n)
                yield mix(np.array([whole], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += n
