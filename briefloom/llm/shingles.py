"""Word shingles and MinHash of texts, in NumPy: hashes of five-word runs, their sets, signatures and exact Jaccard.

Words are runs of letters, digits, underscores and non-ASCII characters of the lower-cased text. A text of one to four
words has one shingle, all its words. Long texts are hashed in pieces cut between words, so memory stays a small
multiple of the text.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np

#: Words of a shingle, and the similarity from which texts are near copies.
WIDTH, SIMILARITY = 5, 0.8
PIECE = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*b"0123456789abcdefghijklmnopqrstuvwxyz_", *b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(128, 256)]] = True


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(n, np.uint64)
    ones[1:] = _BASE
    back = np.ones(n, np.uint64)
    back[1:] = _BASE_INVERSE
    return np.cumprod(ones, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which words begin and end."""
    inside = _WORD_BYTE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of lower-cased UTF-8 bytes."""
    starts, ends = word_spans(data)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + PIECE, side="right")))
        size = int(ends[to - 1] - low)
        power, back = _powers(max(1 << 16, 1 << (size + 1).bit_length()))
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((data[low:low + size].astype(np.uint64) + np.uint64(1)) * power[:size], out=total[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((total[b] - total[a]) * back[a] + (b - a).astype(np.uint64))
        at = to
    return starts, ends, out


_PLACE = [np.uint64(p | 1) for p in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of ``WIDTH`` words, in order; of all words if there are fewer."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    count, width = max(1, n - WIDTH + 1), min(WIDTH, n)
    total = np.full(count, width, np.uint64)
    for i in range(width):
        total += words[i:i + count] * _PLACE[i]
    return mix(total)


def text_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)


def shingle_set(text: str) -> np.ndarray:
    """Distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(word_hashes(text_bytes(text))[2]))


def set_name(shingles: np.ndarray) -> bytes:
    """16 bytes that name a set: texts with the same shingles share it."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


@cache
def hash_family(count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def minhash(shingles: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """``count`` minima of independent hashes of the set (32 bits each)."""
    a, b = hash_family(count, seed)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        values = shingles[at:at + 512, None] * a
        values += b
        np.minimum(least, values.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def jaccard(a: bytes, b: bytes, least: float = SIMILARITY) -> float:
    """Exact Jaccard similarity of two stored sets, or a bound under ``least``; two empty sets are equal."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) and not len(y):
        return 1.0
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return min(len(x), len(y)) / max(len(x), len(y))  # an upper bound, already too low
    both = len(x) + len(y) - len(np.union1d(x, y))
    return both / (len(x) + len(y) - both)
