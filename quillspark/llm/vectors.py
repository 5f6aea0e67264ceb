"""k most similar vectors of every vector (problem 1).

Vantage-point trees in shards. A bounded sample of the vectors (at most MAX_VANTAGES) serves as the
vantage points of the top level; every vector goes to the shard of its nearest vantage point, and
each shard is a binary vantage-point tree with median radii and leaves of at most LEAF vectors.
Distances are chords of the unit vectors, a metric that orders as the cosine does.

Shards that lie close together form groups of at most SPLIT_ROWS rows, and a query goes to a group once,
however many of its shards it visits. First it searches the group of its nearest vantage point, which
bounds its k-th distance by real rows; then it visits a further shard, and a side of a tree node, unless
the triangle inequality, multiplied by a factor, says that nothing there can be among its k nearest.
A factor of 1 is exact search; a larger one prunes more at some loss. A query that lies far from all rows
keeps a wide bound and visits many shards, one within a cluster visits few. A query whose first group has
less than k rows visits all.

A shard larger than SPLIT_ROWS is split by a hash of the id, and the queries that visit a group by
their own beyond SPLIT_QUERIES, so a region that holds a third of all rows or queries is spread over many tasks.

Defined results: a vector is usable if it has exactly `size` values, all finite and not all zero;
others, null and empty ones have no part. A row delivered repeatedly under one id counts once; if its
vectors differ, with the smallest in each group, and of several groups with the nearest.
Ties in the cosine fall to the smaller id. Fewer than k usable vectors: all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.samples import below, smallest

#: Bound of the sample that the top level is fitted on; at most 4096 x 96 floats are broadcast.
MAX_VANTAGES = 4096
#: Visited shards per query that the number of vantage points is balanced for.
VISITS = 8
LEAF = 512
SPLIT_ROWS = 50_000
SPLIT_QUERIES = 50_000
#: Relaxation of the triangle inequality between shards, measured against an exhaustive search for both p1 queries (README).
SHARD_FACTOR = 6.0
#: Relaxation inside a shard's tree.
TREE_FACTOR = 3.0


def usable(vector: str, size: int) -> Column:
    """True for `size` finite values that are not all zero; null and empty vectors give false."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == size) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Unit rows of a list column whose lists all have `size` values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else the squares of tiny or huge values leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


def grouped(vantage: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """The group of each shard: vantage points are halved by rows along a far pair until a group has at most `most` rows or one shard."""
    group, todo, n = np.zeros(len(vantage), np.int32), [np.arange(len(vantage))], 0
    while todo:
        at = todo.pop()
        if len(at) == 1 or sizes[at].sum() <= most:
            group[at] = n
            n += 1
            continue
        x = vantage[at]
        far = x[np.argmin(x @ x[0])]
        at = at[np.argsort(x @ (far - x[np.argmin(x @ far)]), kind="stable")]
        rows = np.cumsum(sizes[at])
        cut = min(len(at) - 1, max(1, int(np.searchsorted(rows, rows[-1] / 2))))
        todo += [at[:cut], at[cut:]]
    return group


class VantageTree:
    """Binary vantage-point tree over the unit rows of x."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf = x, leaf
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # the vantage point that spreads a few others most, tried over evenly spaced candidates
        some = rows[np.linspace(0, len(rows) - 1, 16).astype(int)]
        d = _chord(self.x[some] @ self.x[rows].T)
        at = int(np.argmax(d.std(axis=1)))
        radius = float(np.median(d[at]))
        inside = d[at] <= radius
        if inside.all() or not inside.any():  # ties: equal vectors can't be parted by distance
            return rows
        return self.x[some[at]], radius, self._build(rows[inside]), self._build(rows[~inside])

    def search(self, q: np.ndarray, k: int, bound: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Cosines (-inf: none) and row places of up to k nearest rows; bound: chords beyond which nothing is asked for."""
        best, place, bound = np.full((len(q), k), -np.inf, np.float32), np.full((len(q), k), -1), bound.copy()

        def visit(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, np.ndarray):
                for rows in np.array_split(node, max(1, math.ceil(len(node) / 4096))):
                    for part in np.array_split(at, max(1, math.ceil(len(at) / 2048))):
                        merge(part, rows)
                return
            vantage, radius, inner, outer = node
            gap = _chord(q[at] @ vantage) - radius
            for near, far, side in ((inner, outer, gap <= 0), (outer, inner, gap > 0)):
                visit(near, at[side])
                visit(far, at[side & (np.abs(gap) * factor <= bound[at])])

        def merge(at: np.ndarray, rows: np.ndarray) -> None:
            s = q[at] @ self.x[rows].T
            if s.shape[1] > k:
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                s = np.take_along_axis(s, top, axis=1)
            else:
                top = np.broadcast_to(np.arange(s.shape[1]), s.shape)
            s = np.concatenate([best[at], s], axis=1)
            p = np.concatenate([place[at], rows[top]], axis=1)
            order = np.argpartition(-s, k - 1, axis=1)[:, :k]
            best[at], place[at] = np.take_along_axis(s, order, axis=1), np.take_along_axis(p, order, axis=1)
            worst = best[at].min(axis=1)
            bound[at] = np.minimum(bound[at], np.where(np.isfinite(worst), _chord(worst), np.inf))

        visit(self.root, np.arange(len(q)))
        return best, place


def nearest(
    base: DataFrame, base_id: str, base_vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int = 10, size: int = 96,
    shard_factor: float = SHARD_FACTOR, tree_factor: float = TREE_FACTOR, max_vantages: int = MAX_VANTAGES, out_id: str = "neighbor_id", skip_self: bool = False, half: bool = False,
) -> DataFrame:
    """query_id, out_id, cosine, rank of the k nearest base rows of each usable query vector.

    skip_self: the queries are base rows themselves, and none is its own neighbour.
    half: unit vectors travel in half precision, which halves what is shuffled; cosines are off by some 0.00005, so neighbours that differ by less may change places.
    """
    wanted, k = k, k + skip_self
    form = np.float16 if half else np.float32
    spark = base.sparkSession
    id_type, q_type = base.schema[base_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    b = base.select(F.col(base_id).alias("id"), F.col(base_vector).alias("v")).where(F.col("id").isNotNull() & usable("v", size))
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_vector).alias("v")).where(F.col("qid").isNotNull() & usable("v", size))

    n_queries = max(1, q.count())
    m = int(min(max_vantages, max(4, math.sqrt(VISITS * n_queries))))
    # the rows of smallest hash, twice as many as some are alike; rows delivered twice count once
    n_base = b.agg(F.approx_count_distinct(F.xxhash64("id"), 0.02)).first()[0]
    rows = b.where(below(F.xxhash64("id"), smallest(n_base, 2 * m))).groupBy("id").agg(F.min("v").alias("v")).select("v").toArrow()
    empty = f"qid {q_type}, id {id_type}, cosine double"
    if rows.num_rows == 0:
        top = spark.createDataFrame([], empty)
    else:
        vantage = np.unique(_matrix(rows.column("v"), size), axis=0)
        vantage = vantage[np.random.default_rng(0).permutation(len(vantage))[:m]]  # unique() sorts by the first values
        shared = spark.sparkContext.broadcast(vantage)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            v = shared.value
            for batch in batches:
                x = _matrix(batch.column(1), size)
                near = np.concatenate([(x[i : i + 4096] @ v.T).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.int32()), pa.array([r.tobytes() for r in x.astype(form)], pa.binary())], names=["id", "shard", "x"])

        placed = b.mapInArrow(assign, f"id {id_type}, shard int, x binary")
        sizes = np.zeros(len(vantage), np.int64)
        counts = placed.groupBy("shard").count().collect()  # at most MAX_VANTAGES rows
        for shard, n in counts:
            sizes[shard] = n
        group = grouped(vantage, sizes, SPLIT_ROWS)
        by_group = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.diff(group[by_group], prepend=-1))
        parts = np.maximum(1, -(-np.bincount(group, sizes).astype(np.int64) // SPLIT_ROWS))
        layout = spark.sparkContext.broadcast((group, by_group, starts, parts))

        def distances(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Chords to all vantage points, and the first bound: a sample's k-th distance bounds that of all."""
            d = _chord(x @ shared.value.T)
            return d, np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf, np.float32)

        def visited(d: np.ndarray, bound: np.ndarray) -> np.ndarray:
            """For each row and group, whether any shard of it is to be visited; a bisecting plane lies at least half the difference away."""
            _, by_group, starts, _ = layout.value
            least = np.minimum.reduceat(d[:, by_group], starts, axis=1)
            return (least - d.min(axis=1, keepdims=True)) / 2 * shard_factor <= bound[:, None]

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(layout.value[3]), np.int64)
            for batch in batches:
                x = _matrix(batch.column(1), size)
                for i in range(0, len(x), 1024):
                    total += visited(*distances(x[i : i + 1024])).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["grp", "n"])

        def repeated(at: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Rows and their groups, once for each part of the group."""
            n = layout.value[3][to]
            at, to = np.repeat(at, n), np.repeat(to, n)
            return at, to, np.arange(len(to)) - np.repeat(np.cumsum(n) - n, n)

        def turns(to: np.ndarray) -> pa.Array:
            """Into how many turns the queries of each group are split."""
            return pa.array(split.value[to], pa.int32())

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(1), size)
                for i in range(0, len(x), 4096):
                    some = x[i : i + 4096]
                    at, to, part = repeated(np.arange(len(some)), layout.value[0][(some @ shared.value.T).argmax(axis=1)])
                    raw = [r.tobytes() for r in some.astype(form)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(i + at)), pa.array(to, pa.int32()), pa.array(part, pa.int32()), pa.array([raw[a] for a in at], pa.binary()), turns(to)], names=["qid", "grp", "part", "x", "turns"]
                    )

        def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What a first group gave goes on as it is (without x); part 0 of it sends the query to the other groups."""
            for whole in batches:
                for i in range(0, whole.num_rows, 1024):
                    batch = whole.slice(i, 1024)
                    home, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
                    x = np.frombuffer(b"".join(batch.column(3).to_pylist()), form).astype(np.float32).reshape(-1, size)
                    kth = batch.column(4).to_numpy(zero_copy_only=False)
                    go = visited(distances(x)[0], np.where(np.isfinite(kth), _chord(kth), np.inf))
                    go[np.arange(len(go)), home] = False
                    go[part > 0] = False
                    at, to, nth = repeated(*np.nonzero(go))
                    at = pa.array(at)
                    n, kept = batch.num_rows, batch.num_rows + len(at)
                    sent = [batch.column(0).take(at), pa.array(to, pa.int32()), pa.array(nth, pa.int32()), batch.column(3).take(at), batch.column(4).take(at), pa.nulls(kept - n, batch.column(5).type), pa.nulls(kept - n, batch.column(6).type)]
                    carried = [batch.column(0), batch.column(1), batch.column(2), pa.nulls(n, pa.binary()), batch.column(4), batch.column(5), batch.column(6)]
                    for columns in (carried, sent):
                        whither = columns[1].to_numpy(zero_copy_only=False)
                        yield pa.RecordBatch.from_arrays([*columns, turns(whither)], names=["qid", "grp", "part", "x", "kth", "ids", "cosines", "turns"])

        q_parts = np.ones(len(parts), np.int64)
        for grp, n in q.mapInArrow(tally, "grp int, n bigint").groupBy("grp").agg(F.sum("n")).collect():  # at most MAX_VANTAGES rows
            q_parts[grp] = max(1, -(-n // SPLIT_QUERIES))

        split = spark.sparkContext.broadcast(q_parts)

        def to_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in assign(batches):
                grp = layout.value[0][batch.column(1).to_numpy()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grp, pa.int32()), pa.array(layout.value[3][grp], pa.int32()), turns(grp)], names=["id", "shard", "x", "grp", "parts", "turns"])

        ready = b.mapInArrow(to_group, f"id {id_type}, shard int, x binary, grp int, parts int, turns int")
        points = ready.select("id", "shard", "x", "grp", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
        turn = F.pmod(F.xxhash64("qid"), "turns").cast("int")

        def best_of(left: pd.DataFrame, right: pd.DataFrame, again: bool) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
            """Slices of the queries with cosines and ids' places of up to k nearest rows, and the ids; again: another group was searched before, up to kth."""
            left = left.sort_values(["id", "x"]).drop_duplicates("id", ignore_index=True)
            rows = np.frombuffer(b"".join(left["x"]), form).astype(np.float32).reshape(-1, size)
            trees = {int(s): (VantageTree(rows[at]), at) for s, at in left.groupby("shard").indices.items()}
            for i in range(0, len(right), 8192):
                part = right.iloc[i : i + 8192]
                x = np.frombuffer(b"".join(part["x"]), form).astype(np.float32).reshape(-1, size)
                d, bound = distances(x)
                nearest_shard, d0 = d.argmin(axis=1), d.min(axis=1)
                if again:
                    kth = part["kth"].to_numpy()
                    bound = np.where(np.isfinite(kth), _chord(kth), np.inf)
                best, place = np.full((len(x), k), -np.inf, np.float32), np.full((len(x), k), -1)

                def search(shard: int, at: np.ndarray, x=x, best=best, place=place, bound=bound) -> None:
                    tree, of_rows = trees[shard]
                    s, p = tree.search(x[at], k, bound[at], tree_factor)
                    s, p = np.concatenate([best[at], s], axis=1), np.concatenate([place[at], np.where(p >= 0, of_rows[p], -1)], axis=1)
                    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    best[at], place[at] = np.take_along_axis(s, top, axis=1), np.take_along_axis(p, top, axis=1)
                    worst = best[at].min(axis=1)
                    bound[at] = np.minimum(bound[at], np.where(np.isfinite(worst), _chord(worst), np.inf))

                for shard in trees:
                    search(shard, np.flatnonzero(nearest_shard == shard))
                for shard in trees:
                    search(shard, np.flatnonzero((nearest_shard != shard) & ((d[:, shard] - d0) / 2 * shard_factor <= bound)))
                yield part, best, place, left["id"].to_numpy()

        def search_first(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(right):
                return pd.DataFrame(columns=["qid", "grp", "part", "x", "kth", "ids", "cosines"], dtype=object)
            if not len(left):
                none = [[] for _ in range(len(right))]
                return right[["qid", "grp", "part", "x"]].assign(kth=-np.inf, ids=none, cosines=none)
            found = []
            for part, best, place, ids in best_of(left, right, False):
                has = place >= 0
                found.append(part[["qid", "grp", "part", "x"]].assign(kth=best.min(axis=1).astype(float), ids=[ids[p[h]] for p, h in zip(place, has)], cosines=[s[h].astype(float) for s, h in zip(best, has)]))
            return pd.concat(found, ignore_index=True)

        def search_further(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            found = [pd.DataFrame({"qid": right["qid"][:0], "id": left["id"][:0], "cosine": np.zeros(0)})]
            carried, sent = right[right["x"].isna()], right[right["x"].notna()]
            carried = carried[carried["ids"].map(len) > 0] if len(carried) else carried
            if len(carried):
                n = carried["ids"].map(len)
                found.append(pd.DataFrame({"qid": carried["qid"].to_numpy().repeat(n), "id": np.concatenate(carried["ids"].to_list()), "cosine": np.concatenate(carried["cosines"].to_list())}))
            for part, best, place, ids in best_of(left, sent, True) if len(left) and len(sent) else ():
                # equal cosines may differ in the last digits
                at, nth = np.nonzero((place >= 0) & (best >= part["kth"].to_numpy()[:, None] - 1e-6))
                found.append(pd.DataFrame({"qid": part["qid"].to_numpy()[at], "id": ids[place[at, nth]], "cosine": best[at, nth].astype(float)}))
            return pd.concat(found, ignore_index=True)

        keys = ["grp", "part", "turn"]
        asked = q.mapInArrow(first, f"qid {q_type}, grp int, part int, x binary, turns int").withColumn("turn", turn).drop("turns")
        passed = f"qid {q_type}, grp int, part int, x binary, kth double, ids array<{id_type}>, cosines array<double>"
        home = points.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search_first, passed)
        more = home.mapInArrow(further, passed + ", turns int").withColumn("turn", turn).drop("turns")
        top = points.groupBy(*keys).cogroup(more.groupBy(*keys)).applyInPandas(search_further, empty)
    # one partitioning serves both; an id delivered with differing vectors keeps its best
    once = top.repartition("qid").groupBy("qid", "id").agg(F.max("cosine").alias("cosine"))
    if skip_self:
        once = once.where(F.col("qid") != F.col("id"))
    order = Window.partitionBy("qid").orderBy(F.desc("cosine"), "id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)
    return ranked.select(F.col("qid").alias(query_id), F.col("id").alias(out_id), "cosine", "rank")
