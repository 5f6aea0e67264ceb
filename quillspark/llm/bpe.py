"""Corpus encoding with a public byte-level BPE vocabulary (problem 8).

Words are split by the pattern that the vocabulary's file names (byte-level files without one share PATTERN). The distinct words of an Arrow batch lie in one
flat symbol array and are merged together in rounds: in each round every word finds its pair of
lowest rank by binary search over the sorted pair keys and merges all its occurrences. Words
beyond LONG_WORD bytes, for which rounds would be too many, are merged with a heap instead.

Defined results: null, empty text -> an empty list. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every query that encodes.
TOKENIZER_DIR = "/opt/tokenizers"
#: Splitting pattern of byte-level vocabularies that name none (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_WORD = 1024
NONE = np.iinfo(np.int64).max


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest is moved beyond 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(moved)}


class Bpe:
    """Merge table of one vocabulary as sorted arrays."""

    def __init__(self, folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k.json"):
        self.byte_id = np.zeros(256, np.int64)
        read = self._ranks if name.endswith(".tiktoken") else self._merges
        keys, ranks, ids, pattern = read(f"{folder}/{name}")
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.merged = keys[order], ranks[order], ids[order]
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, np.ndarray] = {}

    def _merges(self, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """Keys of pairs, their ranks, what they become, and the splitting pattern of a JSON file of byte-level merges; others are an error."""
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, pre = whole["model"], whole.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        given = [s["pattern"]["Regex"] for s in steps if s.get("type") == "Split" and "Regex" in s.get("pattern", {})]
        if not any(s.get("type") == "ByteLevel" for s in steps) or whole.get("normalizer"):
            raise ValueError(f"{path} is no byte-level vocabulary")
        vocab = model["vocab"]
        for text, byte in _byte_symbols().items():
            self.byte_id[byte] = vocab[text]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        return keys, np.arange(len(pairs), dtype=np.int64), np.array([vocab[a + b] for a, b in pairs], np.int64), given[0] if given else PATTERN

    def _ranks(self, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """The same of a file of ranks: any two tokens may merge whose bytes together are one, and its id is the rank."""
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        for byte in range(256):
            self.byte_id[byte] = ranks[bytes([byte])]
        found = [(ranks[t[:i]] << 20 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, ids = (np.array(c, np.int64) for c in zip(*found))
        return keys, ids, ids, PATTERN

    def _find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if no merge) and place in the table of each pair."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE), at

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word."""
        done: list[np.ndarray | None] = [None] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                done[i] = self._merge_long(w)
            else:
                short.append(i)
        if short:
            sym = self.byte_id[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
            word = np.repeat(np.arange(len(short)), [len(words[i]) for i in short])
            finished: list[tuple[np.ndarray, np.ndarray]] = []
            while len(sym):
                inner = word[1:] == word[:-1]
                rank, at = self._find(sym[:-1], sym[1:])
                rank = np.where(inner, rank, NONE)
                best = np.full(len(short), NONE)
                np.minimum.at(best, word[:-1], rank)
                live = best[word] != NONE
                if not live.all():  # words without a further merge leave the array
                    finished.append((word[~live], sym[~live]))
                if not live.any():
                    break
                hit = (rank != NONE) & (rank == best[word[:-1]])
                # of overlapping occurrences (a a a) every second one from the left counts
                start = hit & ~np.r_[False, hit[:-1]]
                place = np.arange(len(hit))
                run = place - np.maximum.accumulate(np.where(start, place, 0))
                hit &= run % 2 == 0
                left = np.flatnonzero(hit)
                sym[left] = self.merged[at[left]]
                keep = live.copy()
                keep[left + 1] = False
                sym, word = sym[keep], word[keep]
            if finished:
                fw = np.concatenate([w for w, _ in finished])
                fs = np.concatenate([s for _, s in finished])
                order = np.argsort(fw, kind="stable")
                fw, fs = fw[order], fs[order]
                ends = np.cumsum(np.bincount(fw, minlength=len(short)))
                for j, part in enumerate(np.split(fs, ends[:-1])):
                    done[short[j]] = part.astype(np.int32)
        return [d if d is not None else np.zeros(0, np.int32) for d in done]

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same merges by a heap of (rank, place): n log n for words of any length."""
        sym = self.byte_id[np.frombuffer(word, np.uint8)]
        rank, at = self._find(sym[:-1], sym[1:])
        n = len(sym)
        ids = sym.tolist()
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        heap = [(r, i, m) for i, (r, m) in enumerate(zip(rank.tolist(), self.merged[at].tolist())) if r != NONE]
        pair = {i: r for r, i, _ in heap}
        heapq.heapify(heap)
        keys = self._dict
        while heap:
            r, i, m = heapq.heappop(heap)
            if pair.get(i) != r:
                continue
            j = after[i]
            ids[i], ids[j] = m, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            pair.pop(i, None)
            pair.pop(j, None)
            for a in (before[i], i):
                b = after[a] if a >= 0 else -1
                if b >= 0:
                    found = keys.get(ids[a] << 20 | ids[b])
                    if found:
                        pair[a] = found[0]
                        heapq.heappush(heap, (found[0], a, found[1]))
                    else:
                        pair.pop(a, None)
        return np.array([x for x in ids if x >= 0], np.int32)

    @functools.cached_property
    def _dict(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.merged.tolist())))

    def _words(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, list[str], list[np.ndarray]]:
        """Number of words of each text, the words as places in the distinct words, these, and their ids."""
        counts, flat, place = [], [], {}
        split, setdefault = self.split, place.setdefault
        for t in texts:
            found = split(t) if t else ()
            counts.append(len(found))
            flat.extend([setdefault(w, len(place)) for w in found])
        words = list(place)
        cache = self.cache
        new = [w for w in words if w not in cache]
        if new:
            for w, ids in zip(new, self.merge_words([w.encode("utf-8", "replace") for w in new])):
                cache[w] = ids
        ids = [cache[w] for w in words]
        if len(cache) > 200_000:
            cache.clear()
        return counts, np.array(flat, np.int64), words, ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and flat ids of all texts."""
        counts, flat, words, ids = self._words(texts)
        if not len(flat):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        size = np.array([len(i) for i in ids], np.int64)
        begin = np.r_[0, np.cumsum(size)[:-1]]
        pool = np.concatenate(ids)
        each = size[flat]
        ends = np.cumsum(each)
        out = pool[np.repeat(begin[flat] - np.r_[0, ends[:-1]], each) + np.arange(ends[-1])]
        return np.r_[0, np.r_[0, ends][np.cumsum(counts)]], out

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text, without building them."""
        counts, flat, words, ids = self._words(texts)
        size = np.array([len(i) for i in ids] or [0], np.int64)
        ends = np.r_[0, np.cumsum(size[flat])] if len(flat) else np.zeros(1, np.int64)
        return np.diff(ends[np.r_[0, np.cumsum(counts)].astype(np.int64)])


@functools.lru_cache(maxsize=4)
def vocabulary(folder: str, name: str) -> Bpe:
    """One table per Python worker, however many batches it gets."""
    return Bpe(folder, name)


def encode_texts(df: DataFrame, key: str, text: str, folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k.json", out: str = "ids") -> DataFrame:
    """key and the ids of text for each row, without a shuffle; repeated rows stay repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(folder, name)
        for batch in batches:
            offsets, ids = bpe.encode(batch.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, `{out}` array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str, folder: str = TOKENIZER_DIR, name: str = "byte_bpe_50k.json", out: str = "tokens") -> DataFrame:
    """The columns of keep and the number of ids of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(folder, name)
        for batch in batches:
            sizes = pa.array(bpe.count(batch.column(len(keep)).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], sizes], names=[*keep, out])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{fields}, `{out}` bigint")
