"""Words of many texts as hashes in flat arrays."""

from __future__ import annotations

import numpy as np

from quillspark.llm.language import folded_letters

MIX = np.uint64(0x9E3779B97F4A7C15)


def hashes(codes: np.ndarray, nth: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each word from its letters and their places; starts: where words begin."""
    h = (codes.astype(np.uint64) + np.uint64(1)) * MIX ^ (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC4CEB9FE1A85EC53)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.add.reduceat(h ^ (h >> np.uint64(29)), starts) if len(starts) else np.zeros(0, np.uint64)


def hash_of(word: str) -> np.uint64:
    return hashes(np.array([ord(c) for c in word]), np.arange(len(word)), np.array([0]))[0]


class Words:
    """Runs of letters, look-alike letters and cases as one, invisible characters left out: hash, row and what follows of each."""

    def __init__(self, texts: list[str | None]):
        self.n = len(texts)
        lengths = np.array([len(t) + 1 if t else 1 for t in texts], np.int64)
        raw = np.frombuffer(("\n".join(t or "" for t in texts) + "\n").encode("utf-32-le", "replace"), np.uint32) if texts else np.zeros(0, np.uint32)
        codes = folded_letters()[np.minimum(raw, 65535)]
        keep = codes != 0
        self.codes, self.row_of_code = codes[keep], np.repeat(np.arange(self.n), lengths)[keep]
        letter = self.codes != 32
        begins = letter & np.r_[True, ~letter[:-1]] if len(letter) else letter
        at, first = np.flatnonzero(letter), np.flatnonzero(begins)
        word = (np.cumsum(begins) - 1)[at]
        size = np.bincount(word, minlength=len(first))
        self.row = self.row_of_code[first]
        self.hash = hashes(self.codes[at], at - first[word], np.cumsum(size) - size)
        self.follows = raw[keep][first + size] if len(first) else np.zeros(0, np.uint32)
        self.letters = np.bincount(self.row_of_code[at], minlength=self.n)
        self.count = np.bincount(self.row, minlength=self.n)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows and hashes of neighbouring words of a text."""
        same = self.row[1:] == self.row[:-1]
        return self.row[1:][same], (self.hash[:-1] * MIX ^ self.hash[1:])[same]

    def grams(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and hashes of three letters in sequence, words parted by one blank, of some rows (a mask)."""
        space = self.codes == 32
        some = rows[self.row_of_code] & ~(space & np.r_[True, space[:-1]])
        c, r = self.codes[some].astype(np.uint64), self.row_of_code[some]
        same = r[2:] == r[:-2]
        return r[2:][same], (((c[:-2] * np.uint64(65537) + c[1:-1]) * np.uint64(65537) + c[2:]) * MIX)[same]


def likeness(n: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Shared share (Jaccard) of the hashes of a and b, row by row; 0 where neither has any."""
    keys = [np.unique(row.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24)) for row, h in (a, b)]
    both = np.intersect1d(*keys, assume_unique=True)
    count = lambda k: np.bincount((k >> np.uint64(40)).astype(np.int64), minlength=n)
    common = count(both)
    return common / np.maximum(1, count(keys[0]) + count(keys[1]) - common)
