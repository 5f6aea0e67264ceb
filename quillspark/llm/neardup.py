"""Near-duplicate records: exact similarity self-join of shingle sets (problem 6).

A size-aware heavy-light join. Shingles get one global order by an estimate of their frequency
(a count sketch of bounded size, less what chance adds to a slot). Two sets of similarity t share at least
`l` shingles among the first |x| - ceil(t |x|) + l of each (the prefix). Hence, with a boundary D:

* a block of few rows (such as one result list) is one inverted list and scanned whole;
* light shingles of the prefix (at most D sets have one) are signatures by themselves: their
  inverted lists are short and scanned whole;
* pairs that share no light shingle share two heavy ones in the 2-prefix. Sets with few heavy
  shingles there (at most SMALL) enumerate all subsets of size two as signatures. The others are
  the large sets: they scan the inverted lists of the heavy shingles, where every pair has a large set.

Signatures of heavy shingles are counted in slots as well before their rows are shuffled. A signature with more than SPLIT rows
is split into blocks, and each pair of its blocks is a task of its own, so no task ever holds a list that grows with the input.

D is chosen by cost from the sketch and the numbers of heavy shingles for several D. Candidates pass
a length filter and a 256-bit parity filter (the Hamming distance of the bitmaps never exceeds the
size of the symmetric difference), both without loss, and are verified on the whole shingle sets.

Equal sets are joined as one class: pairs are found between class representatives, and members are
kept aside, so a group of copies of any size costs one row each.

Shingles are `width` consecutive words; words are runs of letters and digits in lower case. Shingles
are compared by 32-bit hashes, which halves all that is shuffled (for two sets of 100 the chance
that this changes their overlap by one is 1 in 400,000), sets by the 64-bit hash of all their shingles.

Defined results: null, empty and short texts (under min_words words) have no part. Rows repeated
under one key count once. A null block is a block of its own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.session import cut

WORDS = re.compile(r"[^\W_]+")
#: Slots of the shingle sketch: 2^22, more for larger inputs so that a slot holds about SLOT_LOAD shingles, up to 2^24 (32 MB when broadcast).
SKETCH_BITS, MOST_SKETCH_BITS, SLOT_LOAD = 22, 24, 64
#: Slots for the numbers of rows with a signature, and the rows of one signature that a task gets at most (twice that for pairs of blocks).
LIST_BITS, SPLIT = 22, 8192
#: Slots for the numbers of rows in blocks, and the size up to which a block is one inverted list by itself.
BLOCK_BITS, SMALL_BLOCK = 18, 128
BITMAP_BITS = 20
SMALL = 48
BOUNDARIES = [128, 256, 512, 1024, 2048, 4096, 8192]
#: Relative costs for the choice of the boundary: a pair looked at in a list, a signature shuffled and sorted.
PAIR_COST, SIGNATURE_COST = 0.02, 1.0
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str | None], salts: np.ndarray, width: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The row of each distinct shingle hash and the hashes, sorted by row; salts keep the blocks apart."""
    place: dict[str, int] = {}
    setdefault, find = place.setdefault, WORDS.findall
    counts, flat = np.zeros(len(texts), np.int64), []
    for i, t in enumerate(texts):
        words = find(t.lower()) if t else ()
        if len(words) >= max(min_words, width):
            counts[i] = len(words)
            flat.extend([setdefault(w, len(place)) for w in words])
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    pool = np.array([xxhash.xxh3_64_intdigest(w) for w in place], np.uint64)
    words, row = pool[np.array(flat, np.int64)], np.repeat(np.arange(len(texts)), counts)
    n = len(words) - width + 1
    h = _mix(salts.astype(np.uint64) + MIX)[row[:n]]
    for j in range(width):
        h = _mix(h * MIX + words[j : n + j])
    inner = row[:n] == row[width - 1 :]
    row, h = row[:n][inner], h[inner] >> np.uint64(32)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]
    return row[new], h[new]


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(32 - bits)).astype(np.int64)


def _block_slot(salts: np.ndarray) -> np.ndarray:
    return salts & (2**BLOCK_BITS - 1)


def _block_sizes(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Upper bounds of the number of rows in a block, by slot (at most 2^18 rows reach the driver), and the bits of the sketch that suits the input."""
    counted = rows.groupBy(F.col("salt").bitwiseAND(2**BLOCK_BITS - 1).alias("slot")).agg(F.count("*").alias("count"), F.sum(F.length("text")).alias("chars")).toArrow()
    sizes = np.zeros(2**BLOCK_BITS, np.int64)
    sizes[counted.column("slot").to_numpy()] = counted.column("count").to_numpy()
    shingles = counted.column("chars").to_numpy().sum() / 6  # about as many as words
    return sizes, int(min(MOST_SKETCH_BITS, max(SKETCH_BITS, math.ceil(math.log2(max(1.0, shingles / SLOT_LOAD))))))


PARTS = 64


def _packed(total: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """Counts by slot in PARTS parts; distances and counts are small numbers, which pack well."""
    per = 2**bits // PARTS
    slots = np.flatnonzero(total)
    for p, own in enumerate(np.split(slots, np.searchsorted(slots, np.arange(1, PARTS) * per))):
        if len(own):
            yield p, zlib.compress(np.diff(own, prepend=p * per).astype(np.uint32).tobytes() + total[own].astype(np.uint32).tobytes(), 1)


def _summed(counts: DataFrame, bits: int) -> np.ndarray:
    """The sums by slot of packed counts (part, packed) of all tasks: 64 rows reach the driver, whatever the input's size."""
    per = 2**bits // PARTS

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(per, np.int64)
        for batch in batches:
            for packed in batch.column("packed").to_pylist():
                both = np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.int64)
                total[np.cumsum(both[: len(both) // 2])] += both[len(both) // 2 :]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()])], names=["part", "sums"])

    total = np.zeros(2**bits, np.int32)
    for part, sums in counts.groupBy("part").applyInArrow(add, "part int, sums binary").collect():
        total[part * per : (part + 1) * per] = np.frombuffer(sums, np.int32)
    return total


def _first_pass(rows: DataFrame, blocks: np.ndarray, bits: int, width: int, min_words: int) -> DataFrame:
    """One reading of all texts, written down: key and cls of each record that has a set, and each task's counts of shingle slots (part, packed)."""
    shared = rows.sparkSession.sparkContext.broadcast(blocks)
    kind = rows.schema["key"].dataType
    arrow = to_arrow_type(kind)
    names = ["key", "cls", "part", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2**bits, np.uint32)
        for batch in batches:
            salts = batch.column(0).to_numpy()
            row, h = shingle_sets(batch.column(1).to_pylist(), salts, width, min_words)
            there, _, n, cls = _classes_of(row, h)
            large = np.repeat(shared.value[_block_slot(salts[there])] > SMALL_BLOCK, n)
            np.add.at(total, _slot(h[large], bits), np.uint32(1))
            none = pa.nulls(len(there), pa.int32()), pa.nulls(len(there), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(there)).cast(arrow), pa.array(cls), *none], names=names)
        for p, packed in _packed(total, bits):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, arrow), pa.nulls(1, pa.int64()), pa.array([p], pa.int32()), pa.array([packed])], names=names)

    return cut(rows.mapInArrow(run, f"key {kind.simpleString()}, cls bigint, part int, packed binary"))


def _sketch(first: DataFrame, bits: int) -> np.ndarray:
    """Estimates of the number of rows with a shingle, by slot, over all larger blocks: 0 and 1 are exact; else the median load, which is what other shingles add, is taken off."""
    total = _summed(first.where("part is not null").select("part", "packed"), bits)
    noise = int(np.median(total))
    return np.minimum(np.where(total <= 1, total, np.maximum(2, total - noise)), 65535).astype(np.uint16)  # far beyond all boundaries


def _prefix(n: np.ndarray, t: float, l: int) -> np.ndarray:
    return np.minimum(n, n - np.ceil(t * n - 1e-9).astype(np.int64) + l)


def _bits(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """256 parity bits of each row's hashes as four words."""
    bit = (_mix(h ^ MIX) & np.uint64(255)).astype(np.int64)
    odd = np.bincount(row * 256 + bit, minlength=rows * 256).reshape(rows, 256) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64)


def _pairs_of_runs(key: np.ndarray, size: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of equal keys and sizes in the proportion t at least, in an array sorted by key and size, in blocks."""
    run = np.cumsum(np.r_[False, key[1:] != key[:-1]]).astype(np.int64)
    order = run << 32 | size
    ends = np.searchsorted(order, run << 32 | np.floor(size / t + 1e-9).astype(np.int64), "right")
    rest = ends - np.arange(len(key)) - 1
    at = np.flatnonzero(rest)
    while len(at):
        total = np.cumsum(rest[at])
        n = max(1, int(np.searchsorted(total, 1_000_000, "right")))
        now, at = at[:n], at[n:]
        left = np.repeat(now, rest[now])
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(rest[now]) - rest[now], rest[now])


def _similar(size_a: np.ndarray, size_b: np.ndarray, bits_a: np.ndarray, bits_b: np.ndarray, t: float) -> np.ndarray:
    """False only where the bitmaps rule out a similarity of t."""
    differ = np.zeros(len(size_a), np.int64)
    for w in range(bits_a.shape[1]):
        differ += np.bitwise_count(bits_a[:, w] ^ bits_b[:, w])
    return differ <= (1 - t) / (1 + t) * (size_a + size_b) + 1e-9


def _rows(records: DataFrame, key: str, text: str, block: Column | None) -> DataFrame:
    salt = F.xxhash64(block) if block is not None else F.lit(0).cast("bigint")
    return records.select(salt.alias("salt"), F.col(text).alias("text"), F.col(key).alias("key")).where(F.col("text").isNotNull())


def _classes_of(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a set, its place and size among the shingles, and the hash of the whole set."""
    there, first, n = np.unique(row, return_index=True, return_counts=True)
    cls = np.add.reduceat(_mix(_mix(h + MIX) * MIX), first) if len(first) else np.zeros(0, np.uint64)
    return there, first, n, _mix(cls).view(np.int64)


def _bitmap(slots: DataFrame) -> np.ndarray:
    """The 2^20 bits of a column of slots; at most 2^20 numbers reach the driver."""
    bits = np.zeros(2**BITMAP_BITS, bool)
    bits[slots.distinct().toArrow().column(0).to_numpy()] = True
    return np.packbits(bits)


def _bit_slot(column: str) -> Column:
    return F.col(column).bitwiseAND(2**BITMAP_BITS - 1)


def _has_bit(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = values & (2**BITMAP_BITS - 1)
    return (bitmap[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def class_sets(rows: DataFrame, first: DataFrame, shared, blocks: np.ndarray, sketch: int, width: int, min_words: int, t: float) -> DataFrame:
    """cls, list (of a small block, else null), shingles (in global order), heavy (heavy shingles in the 2-prefix by boundary), one row for each class.

    Only sets that may occur more than once (by a bitmap of the repeated classes) are shuffled to find
    their classes' single row; where the bitmap is full, that is all of them.
    """
    repeated = first.where("key is not null").groupBy("cls").count().where("count > 1").select(_bit_slot("cls").alias("slot"))
    bits = rows.sparkSession.sparkContext.broadcast((_bitmap(repeated), blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, (repeated, blocks) = shared.value, bits.value
            salts = batch.column(0).to_numpy()
            row, h = shingle_sets(batch.column(1).to_pylist(), salts, width, min_words)
            there, first, n, cls = _classes_of(row, h)
            small = blocks[_block_slot(salts[there])] <= SMALL_BLOCK
            lists_of = pa.array(salts[there], pa.int64(), mask=~small)
            est = np.where(np.repeat(small, n), 0, total[_slot(h, sketch)])
            order = np.lexsort((h, est, row))
            h, est = h[order], est[order]
            two = np.arange(len(h)) - np.repeat(first, n) < np.repeat(_prefix(n, t, 2), n)
            heavy = np.stack([np.add.reduceat((est > d) & two, first, dtype=np.int32) if len(first) else np.zeros(0, np.int32) for d in BOUNDARIES], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(h)].astype(np.int32)), pa.array(h.astype(np.uint32).view(np.int32)))
            counts = pa.ListArray.from_arrays(pa.array((np.arange(len(cls) + 1) * len(BOUNDARIES)).astype(np.int32)), pa.array(heavy.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(cls), lists_of, lists, counts, pa.array(_has_bit(repeated, cls))], names=["cls", "list", "shingles", "heavy", "maybe"])

    every = cut(rows.select("salt", "text").mapInArrow(run, "cls bigint, list bigint, shingles array<int>, heavy array<int>, maybe boolean"))
    once = every.where("not maybe").unionByName(cut(every.where("maybe").dropDuplicates(["cls"])))
    return once.drop("maybe")


def _boundary(sets: DataFrame, total: np.ndarray, t: float) -> int:
    """The boundary of least cost: pairs in light lists against signatures of heavy subsets and pairs in large sets' lists."""
    many = len(BOUNDARIES)
    sums = []
    for i in range(many):
        h = F.element_at("heavy", i + 1).cast("double")
        sums += [F.sum(F.when(h <= SMALL, h * (h - 1) / 2).otherwise(h)), F.sum(F.when(h > SMALL, 1).otherwise(0)), F.sum(h)]
    row = [float(x or 0) for x in sets.agg(*sums).first()]
    costs = []
    for i, d in enumerate(BOUNDARIES):
        light = total[(total > 1) & (total <= d)].astype(float) * (1 - t)
        heavy = total[total > d].astype(float) * (1 - t)
        subsets, large, posts = row[3 * i : 3 * i + 3]
        scans = large * (heavy.mean() if len(heavy) else 0) * posts / max(1, sets_rows(row)) if large else 0
        costs.append(PAIR_COST * ((light**2).sum() / 2 + scans) + SIGNATURE_COST * (light.sum() + subsets + (posts if large else 0)))
    return BOUNDARIES[int(np.argmin(costs))]


def sets_rows(row: list[float]) -> float:
    return max(row[2::3]) or 1.0


def _splits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots of signatures that have more than SPLIT rows, into how many blocks they are split); what chance adds to a slot doesn't count."""
    noise = float(np.median(counts))
    beyond = counts - noise - 6 * math.sqrt(noise)
    hot = np.flatnonzero(beyond > SPLIT)
    return hot, np.ceil(beyond[hot] / SPLIT).astype(np.int64)


def similar_classes(sets: DataFrame, total: np.ndarray, shared, sketch: int, t: float) -> DataFrame:
    """a, b, similarity of each pair of classes with a similarity of at least t; sets: cls, shingles, heavy, one row per class."""
    d = _boundary(sets, total, t)
    at = BOUNDARIES.index(d)
    any_large = not sets.where(F.element_at("heavy", at + 1) > SMALL).isEmpty()

    def signatures(batch: pa.RecordBatch, every: bool) -> tuple[np.ndarray | None, ...]:
        """(key, place of the row, role: 0 in a list or subset, 1 small or 2 large in a heavy list) of each signature (or of the heavy ones alone), and cls, size and bitmap (if every) of each row."""
        cls, lists = batch.column(0).to_numpy(), batch.column(2)
        small = np.array(batch.column(1).is_valid())
        own_list = batch.column(1).fill_null(0).to_numpy().view(np.uint64)
        n = np.diff(lists.offsets.to_numpy().astype(np.int64))
        h = lists.flatten().to_numpy().view(np.uint32).astype(np.uint64)
        row = np.repeat(np.arange(len(cls)), n)
        begin = np.cumsum(n) - n
        pos = np.arange(len(h)) - np.repeat(begin, n)
        est = np.where(small[row], 0, shared.value[_slot(h, sketch)])
        keys, rows, roles = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
        if every:
            light = (est <= d) & (est > 1) & (pos < _prefix(n, t, 1)[row])
            # a small block is one inverted list
            keys, rows, roles = [_mix(h[light]), _mix(own_list[small] + MIX)], [row[light], np.flatnonzero(small)], [np.zeros(light.sum() + small.sum(), np.int8)]
        heavy = (est > d) & (pos < _prefix(n, t, 2)[row])
        large = np.bincount(row[heavy], minlength=len(cls)) > SMALL
        few = heavy & ~large[row]
        fr, fh = row[few], h[few]
        fn = np.bincount(fr, minlength=len(cls))
        after = np.repeat(np.cumsum(fn), fn) - np.arange(len(fr)) - 1
        left = np.repeat(np.arange(len(fr)), after)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
        # both ends of a subset come in the global order, so equal subsets have equal keys
        keys.append(_mix(fh[left] * MIX + _mix(fh[right])))
        rows.append(fr[left])
        roles.append(np.zeros(len(left), np.int8))
        if any_large:
            keys.append(_mix(h[heavy] ^ MIX))
            rows.append(row[heavy])
            roles.append(np.where(large[row[heavy]], 2, 1).astype(np.int8))
        return np.concatenate(keys), np.concatenate(rows), np.concatenate(roles), cls, n, _bits(row, h, len(cls)) if every else None

    list_slot = lambda key: (key >> np.uint64(64 - LIST_BITS)).astype(np.int64)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(2**LIST_BITS, np.uint32)
        for batch in batches:
            np.add.at(count, list_slot(signatures(batch, False)[0]), np.uint32(1))
        for p, packed in _packed(count, LIST_BITS):
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([packed])], names=["part", "packed"])

    given = sets.select("cls", "list", "shingles")
    # lists of light shingles and of small blocks are short by themselves, so only sets with heavy shingles are counted
    heavy_sets = sets.where(F.element_at("heavy", at + 1) > 0).select("cls", "list", "shingles")
    split = sets.sparkSession.sparkContext.broadcast(_splits(_summed(heavy_sets.mapInArrow(tally, "part int, packed binary"), LIST_BITS)))

    def spread(key: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, key, side) of each copy: a row of a split signature meets each of its blocks once. Side 0 and 1 are the two blocks of a pair, 2 is one block by itself."""
        hot, blocks = split.value  # slots: a light list in the slot of a split signature is split as well, at no loss
        if not len(hot):
            return np.arange(len(key)), key, np.full(len(key), 2)
        slot = list_slot(key)
        at = np.minimum(np.searchsorted(hot, slot), len(hot) - 1)
        g = np.where(hot[at] == slot, blocks[at], 1)
        place = np.repeat(np.arange(len(key)), g)
        other = np.arange(len(place)) - np.repeat(np.cumsum(g) - g, g)
        own = (_mix(cls.view(np.uint64) ^ MIX) % g.astype(np.uint64)).astype(np.int64)[place]
        pair = np.minimum(own, other) * g[place] + np.maximum(own, other)
        keys = np.where(g[place] > 1, _mix(key[place] + MIX * (pair + 1).astype(np.uint64)), key[place])
        return place, keys, np.where(own == other, 2, np.where(own < other, 0, 1))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row, role, cls, n, bits = signatures(batch, True)
            for low in range(0, len(key), 100_000):
                part = slice(low, low + 100_000)
                place, keys, side = spread(key[part], cls[row[part]])
                for i in range(0, len(place), 100_000):
                    p = place[i : i + 100_000] + low
                    r = row[p]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[i : i + 100_000].view(np.int64)), pa.array(cls[r]), pa.array(n[r] << 4 | side[i : i + 100_000] << 2 | role[p]), *(pa.array(bits[r, w].view(np.int64)) for w in range(4))],
                        names=["sig", "cls", "n", "b0", "b1", "b2", "b3"],
                    )

    fields = "sig bigint, cls bigint, n bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def pairs(part: pa.Table) -> Iterator[pa.RecordBatch]:
            key, cls, n = (part.column(c).to_numpy() for c in ("sig", "cls", "n"))
            role, side, n = n & 3, n >> 2 & 3, n >> 4
            bits = np.stack([part.column(f"b{w}").to_numpy().view(np.uint64) for w in range(4)], axis=1)
            for i, j in _pairs_of_runs(key, n, t):
                # in a heavy list one of the two is large; of two blocks one row each
                ok = ((role[i] | role[j]) != 1) & (cls[i] != cls[j]) & ((side[i] == 2) | (side[i] != side[j]))
                i, j = i[ok], j[ok]
                ok = _similar(n[i], n[j], bits[i], bits[j], t)
                a, b = cls[i[ok]], cls[j[ok]]
                if len(a):
                    once = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], names=["a", "b"])

        for batch in batches:
            now = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            key = now.column("sig").to_numpy()
            # the last run may go on in the next batch
            end = int(np.flatnonzero(key[1:] != key[:-1])[-1]) + 1 if (key[1:] != key[:-1]).any() else 0
            if end:
                yield from pairs(now.slice(0, end))
            kept = now.slice(end).combine_chunks()
        if kept is not None and len(kept):
            yield from pairs(kept)

    signed = given.mapInArrow(sign, fields)
    sorted_ = signed.repartition("sig").sortWithinPartitions("sig", "n")
    candidates = cut(sorted_.mapInArrow(join, "a bigint, b bigint").distinct())
    ends = candidates.select(F.explode(F.array("a", "b")).alias("c")).select(_bit_slot("c").alias("slot"))
    wanted = sets.sparkSession.sparkContext.broadcast(_bitmap(ends))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_has_bit(wanted.value, batch.column(0).to_numpy())))

    # only sets that may be an end of a candidate are shuffled
    sets = sets.select("cls", "shingles").mapInArrow(pick, "cls bigint, shingles array<int>")
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = candidates.join(left, "a").join(right, "b").withColumn("c", F.size(F.array_intersect("sa", "sb")))
    rated = both.withColumn("similarity", F.col("c") / (F.size("sa") + F.size("sb") - F.col("c")))
    return rated.where(F.col("similarity") >= t - 1e-9).select("a", "b", "similarity")


def near_duplicates(records: DataFrame, key: str, text: str, block: Column | None = None, width: int = 5, min_words: int = 20, t: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(links between classes: a, b, similarity; membership: key, cls). A class is a set of equal shingle sets of a block."""
    rows = _rows(records, key, text, block)
    blocks, bits = _block_sizes(rows)
    first = _first_pass(rows, blocks, bits, width, min_words)
    total = _sketch(first, bits)
    shared = records.sparkSession.sparkContext.broadcast(total)
    sets = class_sets(rows, first, shared, blocks, bits, width, min_words, t)
    return similar_classes(sets, total, shared, bits, t), first.where("key is not null").select("key", "cls").distinct()


def spread_members(members: DataFrame, most: int = SPLIT) -> tuple[DataFrame, DataFrame | None]:
    """(members with salt; cls and parts of the classes of more than `most` members): the members of a class are spread over its parts. Without such classes (members, None)."""
    hot = members.groupBy("cls").count().where(F.col("count") > most).select("cls", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    if hot.isEmpty():
        return members, None
    return members.join(hot, "cls", "left").select(*members.columns, F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt")), hot


def with_members(pairs: DataFrame, cls: str, spread: DataFrame, hot: DataFrame | None, out: str) -> DataFrame:
    """pairs with a row for each member (out) of the class in column cls; a class of many members is met part by part."""
    if hot is None:
        return pairs.join(spread.select(F.col("cls").alias(cls), F.col("key").alias(out)), cls)
    parts = pairs.join(hot.withColumnRenamed("cls", cls), cls, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return parts.join(spread.select(F.col("cls").alias(cls), F.col("key").alias(out), "salt"), [cls, "salt"]).drop("salt")
