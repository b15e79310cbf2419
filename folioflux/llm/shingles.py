"""Shingle sets of texts as arrays, a frequency sketch over all of them, and exact overlap bounds.

All arrays of a batch are flat: one value per shingle, with the row it belongs to beside it.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Buckets of the frequency sketch (fixed size whatever the corpus) and how it is cut for adding up.
SKETCH_BITS, SKETCH_BLOCK = 21, 1 << 15
#: Bits of a set's widest bitmap; narrower ones are folded from it.
WIDEST = 1024


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _STEP[0]
    x = (x ^ (x >> np.uint64(27))) * _STEP[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash by word; emptied when it holds two million words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 21:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "replace"))
        return h


WORDS = WordHashes()


def word_array(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text) of texts whose words stand between single spaces."""
    look, flat, sizes = WORDS.__getitem__, [], []
    for t in texts:
        words = t.split(" ") if t else []
        flat.extend(map(look, words))
        sizes.append(len(words))
    return np.array(flat, dtype=np.uint64), np.array(sizes, dtype=np.int64)


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of all distinct shingles, by row; a text of fewer words than width has none."""
    words, sizes = word_array(texts)
    if len(words) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = mix(h + words[k : k + n] + _MIX * np.uint64(k + 1))
    whole = row[:n] == row[width - 1 :]
    row, h = row[:n][whole], h[whole]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_class(counts: np.ndarray) -> np.ndarray:
    """0: in no set; 1: in one; then eight classes for each doubling, of which two bytes hold any count."""
    return np.where(counts < 1, 0, 1 + np.floor(8 * np.log2(np.maximum(counts, 1)))).astype(np.uint16)


def class_count(cls: np.ndarray) -> np.ndarray:
    """Upper bound of the counts of a class."""
    return 2.0 ** (cls.astype(np.float64) / 8)


def class_least(cls: np.ndarray) -> np.ndarray:
    """The least count of a class; up to 7 the only one."""
    return np.where(cls == 0, 0, np.minimum(2.0**62, np.ceil(2.0 ** ((cls.astype(np.float64) - 1) / 8) - 1e-9))).astype(np.int64)


def alone(freq: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Buckets that one set at most has, by one sketch or by two over different sets."""
    return freq <= 1 if more is None else (freq <= 1) & (more <= 1) & ((freq == 0) | (more == 0))


def bitmaps(row: np.ndarray, h: np.ndarray, rows: int) -> list[bytes]:
    """Parity bitmap of each row's set, as wide as its size asks for.

    The Hamming distance of two sets' bitmaps of one width is at most the size of the sets'
    symmetric difference, so it bounds their overlap from above.
    """
    place = ((h * _MIX) >> np.uint64(54)).astype(np.int64)
    bits = (np.bincount(row * WIDEST + place, minlength=rows * WIDEST) & 1).astype(np.uint8)
    wide = np.packbits(bits.reshape(rows, WIDEST), axis=1, bitorder="little")
    size = np.bincount(row, minlength=rows)
    out: list[bytes] = [b""] * rows
    width = WIDEST // 8
    while True:
        here = size > width * 2 if width > 16 else size >= 0
        here &= np.array([not x for x in out]) if width < WIDEST // 8 else True
        for r in np.nonzero(here)[0]:
            out[r] = wide[r].tobytes()
        if width == 16:
            return out
        width //= 2
        wide = wide[:, :width] ^ wide[:, width:]


class Threshold:
    """A Jaccard threshold as a fraction, so that sizes at the border come out exactly."""

    def __init__(self, text: str):
        f = Fraction(text)
        self.num, self.den = f.numerator, f.denominator

    def least_partner(self, n):
        """The smallest set that can reach the threshold with a set of n."""
        return -(-self.num * n // self.den)

    def prefix(self, n):
        return n - self.least_partner(n) + 1

    def overlap(self, n, m):
        """The least overlap of sets of n and m at the threshold."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def reached(self, common: int, n: int, m: int) -> bool:
        return self.den * common >= self.num * (n + m - common)
