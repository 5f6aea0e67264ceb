"""Retrieval: exact nearest neighbours in blocks, keyword matching over an inverted list, hybrid scores, fusion, parents.

Queries are a table, so a search of many queries is one plan. No operator broadcasts a table or
pairs all rows in the JVM: the exact search writes the rows once, and tasks multiply their queries with blocks of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.functions import scoring, text, vectors
from quillspark.operators.matching import contains
from quillspark.operators.tables import meaningful, not_parent
from quillspark.session import cut, stored, stored_batches

#: Rows of one block of queries, and of stored vectors; a task multiplies one of each.
QUERY_BLOCK, BASE_BLOCK = 32_768, 65_536
#: Rows of queries and of stored vectors that are multiplied at once, and what a similarity in single precision may be off by.
QUERY_SLICE, ROW_SLICE, MARGIN = 512, 8192, 1e-5
#: Queries with one vector that are searched as one.
SHARED = 64


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """The rows of a list column whose lists all have `size` values, without a Python object for each."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _best(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, rounded to nine places; ties to the smaller column. Only what reaches the k-th largest is sorted."""
    r = np.round(s, 9)
    kth = -np.partition(-r, min(k, r.shape[1]) - 1, axis=1)[:, min(k, r.shape[1]) - 1]
    at, nth = np.nonzero(r >= kth[:, None])
    order = np.lexsort((nth, -r[at, nth], at))
    at, nth = at[order], nth[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    return at[place < k], nth[place < k]


def _similarity(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Similarities (larger is nearer) of all rows of a to all rows of b."""
    if metric == "dot":
        return a @ b.T
    if metric == "euclid":
        return -np.sqrt(np.maximum(0, (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T))
    if metric == "manhattan":
        return -np.stack([np.abs(b - x).sum(axis=1) for x in a])
    na, nb = np.linalg.norm(a, axis=1)[:, None], np.linalg.norm(b, axis=1)[None, :]
    return np.where(na * nb > 0, a @ b.T / np.where(na * nb > 0, na * nb, 1), 0.0)


def _packed(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """df's keys and its vectors v of `size` values as bytes: the fewest for a value that keep all of a batch exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(len(keys)).flatten().to_numpy(zero_copy_only=False)
            for kind in (np.float16, np.float32):
                with np.errstate(over="ignore"):
                    small = flat.astype(kind)
                if (small.astype(np.float64) == flat).all():
                    flat = small
                    break
            else:
                flat = flat.astype(np.float64)
            width = flat.itemsize * size
            at = pa.py_buffer(np.arange(0, width * batch.num_rows + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, at, pa.py_buffer(flat.tobytes())])], names=[*keys, "v"])

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, "v").mapInArrow(run, f"{fields}, v binary")


def _unpacked(column: pa.Array, size: int) -> np.ndarray:
    rows = column.to_pylist()
    kinds = {8 * size: np.float64, 4 * size: np.float32, 2 * size: np.float16}
    if len({len(r) for r in rows}) == 1:
        return np.frombuffer(b"".join(rows), kinds[len(rows[0])]).astype(np.float64).reshape(-1, size)
    return np.array([np.frombuffer(r, kinds[len(r)]) for r in rows], np.float64).reshape(-1, size)


class _Near:
    """The k nearest rows so far of a block of queries; equal similarities (to nine places) go to the smaller id."""

    def __init__(self, q: np.ndarray, k: int, metric: str, floor: float):
        self.q, self.k, self.metric, self.floor = (_unit(q) if metric == "cosine" else q), k, metric, floor
        self.q32 = self.q.astype(np.float32)
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        self.bound = np.full(len(q), floor)

    def look(self, ids: np.ndarray, x: np.ndarray, x32: np.ndarray, only: np.ndarray | None = None) -> None:
        """x: rows in the order of their ids (of unit length for cosine); only: the places of the queries that look, else all do."""
        only = np.arange(len(self.q)) if only is None else only
        q, q32, bound, found = self.q[only], self.q32[only], self.bound[only], []
        for i in range(0, len(x), ROW_SLICE):
            hit = None
            if self.metric == "cosine" and np.isfinite(bound).all():
                # single precision leaves out what surely is too far; what stays is worked out in double
                hit = np.flatnonzero(q32 @ x32[i : i + ROW_SLICE].T >= (bound - MARGIN).astype(np.float32)[:, None])
            if hit is not None and len(hit) <= 4 * self.k * len(q):
                at, nth = np.divmod(hit, len(x32[i : i + ROW_SLICE]))
                s = np.einsum("ij,ij->i", q[at], x[i + nth])
            else:
                every = q @ x[i : i + ROW_SLICE].T if self.metric == "cosine" else _similarity(q, x[i : i + ROW_SLICE], self.metric)
                at, nth = _best(every, self.k)
                s = every[at, nth]
                if every.shape[1] >= self.k:
                    bound = np.maximum(bound, np.round(s[self.k - 1 :: self.k], 9) - 1e-9)
            fits = s >= np.maximum(bound[at], self.floor)
            found.append((at[fits], i + nth[fits], s[fits]))
        at, nth, s = (np.concatenate(c) for c in zip(*found))
        if len(at):
            self._take(only[at], ids[nth], s)

    def _take(self, at: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        row, score, name = np.concatenate([self.row, at]), np.concatenate([self.score, s]), np.concatenate([self.id, ids])
        r = np.round(score, 9)
        order = np.lexsort((-r, row))
        if ((np.diff(row[order]) == 0) & (np.diff(r[order]) == 0)).any():
            order = np.lexsort((np.unique(name, return_inverse=True)[1], -r, row))
        row = row[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        self.row, self.score, self.id = row[first], score[order][first], name[order][first]
        n = np.bincount(self.row, minlength=len(self.q))
        ends = np.cumsum(n) - 1
        full = n == self.k
        self.bound = np.full(len(self.q), self.floor)
        self.bound[full] = np.maximum(self.floor, np.round(self.score[ends[full]], 9) - 1e-9)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; those without length stay zero."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def nearest(
    base: DataFrame, base_id: str, base_vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int, size: int,
    threshold: float | None = None, metric: str = "cosine", out_id: str = "id",
) -> DataFrame:
    """query_id, out_id, score, rank of the exact k nearest base rows of each query; ties by id.

    The rows' vectors are written once to the shared folder, and each task reads all of them, block by block, for its own queries:
    nothing is shuffled but each side once. Vectors of another size or with values that aren't finite have no part; rows repeated under an id count once.
    """
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_vector).alias("v"))
    found = _nearest_of(_vectors_of(base, base_id, base_vector, size), q, k, size, threshold, metric)
    return found.select(F.col("qid").alias(query_id), F.col("id").alias(out_id), "score", "rank")


def _vectors_of(base: DataFrame, base_id: str, base_vector: str, size: int) -> DataFrame:
    """id and v (packed) of the usable vectors, each id once."""
    b = base.select(F.col(base_id).alias("id"), F.col(base_vector).alias("v")).where(F.col("id").isNotNull() & vectors.valid(F.col("v"), size))
    return _packed(b, ["id"], size).groupBy("id").agg(F.min("v").alias("v"))


def _nearest_of(b: DataFrame, q: DataFrame, k: int, size: int, threshold: float | None = None, metric: str = "cosine", shared: bool = False) -> DataFrame:
    """qid, id, score, rank of the k nearest rows of b (id, v packed, each id once) for each row of q (qid, v).

    shared: each qid has one row, and those with the same vector, up to SHARED, are searched once; the result is qid and the lists ids and scores.
    """
    q = q.where(F.col("qid").isNotNull() & vectors.valid(F.col("v"), size))
    parts = max(math.ceil(q.count() / QUERY_BLOCK), b.sparkSession.sparkContext.defaultParallelism)
    path = stored(b)
    asked = _packed(q, ["qid"], size)
    if shared:
        nth = F.floor((F.row_number().over(Window.partitionBy("v").orderBy("qid")) - 1) / SHARED)
        asked = asked.repartition(parts, "v").withColumn("__n", nth).groupBy("v", "__n").agg(F.collect_list("qid").alias("qid")).select("qid", "v")
    else:
        asked = asked.repartition(parts, "qid").groupBy("qid").agg(F.min("v").alias("v"))
    id_type, q_type = b.schema["id"].dataType.simpleString(), asked.schema["qid"].dataType.simpleString()
    floor = -math.inf if threshold is None else threshold
    id_arrow = to_arrow_type(b.schema["id"].dataType)
    block, rows = QUERY_BLOCK, BASE_BLOCK

    def search(own: pa.Table) -> Iterator[pa.RecordBatch]:
        v = _unpacked(own.column("v").combine_chunks(), size)
        near = [(i, _Near(v[i : i + QUERY_SLICE], k, metric, floor)) for i in range(0, len(v), QUERY_SLICE)]
        for batch in stored_batches(path, rows):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            x = _unpacked(batch.column(1), size)[order]
            x = _unit(x) if metric == "cosine" else x
            x32 = x.astype(np.float32)
            for _, n in near:
                n.look(ids[order], x, x32)
        for i, n in near:
            if shared:
                some, at = np.unique(n.row, return_index=True)
                at = pa.array(np.append(at, len(n.row)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([own.column("qid").combine_chunks().take(pa.array(some + i)), pa.ListArray.from_arrays(at, pa.array(n.id.tolist(), id_arrow)), pa.ListArray.from_arrays(at, pa.array(n.score))], names=["qid", "ids", "scores"])
                continue
            rank = np.arange(len(n.row)) - np.searchsorted(n.row, n.row) + 1
            yield pa.RecordBatch.from_arrays([own.column("qid").combine_chunks().take(pa.array(n.row + i)), pa.array(n.id.tolist(), id_arrow), pa.array(n.score), pa.array(rank.astype(np.int32))], names=["qid", "id", "score", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= block:
                yield from search(pa.Table.from_batches(held))
                held = []
        if sum(h.num_rows for h in held):
            yield from search(pa.Table.from_batches(held))

    if shared:
        return asked.mapInArrow(run, f"qid {q_type}, ids array<{id_type}>, scores array<double>").withColumn("qid", F.explode("qid"))
    return asked.mapInArrow(run, f"qid {q_type}, id {id_type}, score double, rank int")


#: Cells that rows are parted into, rows of the sample that they are fitted on, rows of the index that a task holds at once, and cells that a query looks into.
CELLS, CELL_SAMPLE, CELL_ROWS, PROBES = 256, 16_384, 65_536, 16


def _centres(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of `cells` groups of unit rows, by a few rounds of k-means from evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        n = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(n > 0, total / np.where(n > 0, n, 1), centres)
    return centres


def nearest_approximate(
    base: DataFrame, base_id: str, base_vector: str, queries: DataFrame, query_id: str, query_vector: str, k: int, size: int, probes: int = PROBES, cells: int = CELLS, out_id: str = "id",
) -> DataFrame:
    """query_id, out_id, score, rank of k near base rows by cosine: rows lie in cells, and a query looks into the `probes` nearest cells.

    Centres are fitted on a sample of CELL_SAMPLE rows of smallest hash; every row is in the index, which is written once to the shared folder.
    Each task reads it for its own queries. With as many probes as cells the search is exact. Vectors of another size, not finite, or all zero have no part.
    """
    spark = base.sparkSession
    id_type, q_type = base.schema[base_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    fit = lambda v: vectors.valid(v, size) & F.exists(v, lambda x: x != 0)
    b = base.select(F.col(base_id).alias("id"), F.col(base_vector).alias("v")).where(F.col("id").isNotNull() & fit(F.col("v")))
    q = queries.select(F.col(query_id).alias("qid"), F.col(query_vector).alias("v")).where(F.col("qid").isNotNull() & fit(F.col("v")))
    n = max(1, b.count())
    share = min(1.0, (CELL_SAMPLE + 7 * math.sqrt(CELL_SAMPLE)) / n)
    taken = b.where(F.xxhash64("id").cast("double") <= F.lit(-(2.0**63) + 2.0**64 * share)).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").select("v").toArrow()
    if taken.num_rows == 0:
        return q.where("false").select(F.col("qid").alias(query_id), F.lit(None).cast(id_type).alias(out_id), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    shared = spark.sparkContext.broadcast(_centres(_unit(_matrix(taken.column("v"), size)), cells))  # CELLS x size numbers
    probes = min(probes, len(shared.value))

    def cells_of(x: np.ndarray, most: int) -> np.ndarray:
        s = np.concatenate([_unit(x[i : i + 4096]) @ shared.value.T for i in range(0, len(x), 4096)])
        return np.argpartition(-s, most - 1, axis=1)[:, :most] if most < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)

    id_arrow, rows = to_arrow_type(b.schema["id"].dataType), CELL_ROWS
    path = stored(_packed(b, ["id"], size).groupBy("id").agg(F.min("v").alias("v")))
    asked = _packed(q, ["qid"], size).repartition(max(math.ceil(q.count() / QUERY_BLOCK), spark.sparkContext.defaultParallelism), "qid").groupBy("qid").agg(F.min("v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if not held:
            return
        own = pa.Table.from_batches(held)
        v = _unpacked(own.column("v").combine_chunks(), size)
        looks = cells_of(v, probes)
        near = [(i, _Near(v[i : i + QUERY_SLICE], k, "cosine", -math.inf)) for i in range(0, len(v), QUERY_SLICE)]
        # which queries of each slice look into a cell
        looking = [[np.flatnonzero((looks[i : i + QUERY_SLICE] == c).any(axis=1)) for c in range(len(shared.value))] for i, _ in near]
        for batch in stored_batches(path, rows):
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), _unit(_unpacked(batch.column(1), size))
            cell = cells_of(x, 1)[:, 0]
            order = np.argsort(ids, kind="stable")
            order = order[np.argsort(cell[order], kind="stable")]
            ids, x, cell = ids[order], x[order], cell[order]
            x32 = x.astype(np.float32)
            for c in np.unique(cell):
                here = slice(*np.searchsorted(cell, [c, c + 1]))
                for (_, n), of_cell in zip(near, looking):
                    if len(of_cell[c]):
                        n.look(ids[here], x[here], x32[here], of_cell[c])
        for i, n in near:
            rank = np.arange(len(n.row)) - np.searchsorted(n.row, n.row) + 1
            yield pa.RecordBatch.from_arrays([own.column("qid").combine_chunks().take(pa.array(n.row + i)), pa.array(n.id.tolist(), id_arrow), pa.array(n.score), pa.array(rank.astype(np.int32))], names=["qid", "id", "score", "rank"])

    found = asked.mapInArrow(run, f"qid {q_type}, id {id_type}, score double, rank int")
    return found.select(F.col("qid").alias(query_id), F.col("id").alias(out_id), "score", "rank")


def repository_nearest(chunks: DataFrame, queries: DataFrame, limit: int, mode: str = "balanced", size: int = 96, least: int = 80) -> DataFrame:
    """query_id, id, score, rank: the nearest stored chunks of a model, no parents, with texts long enough, of at least the mode's similarity."""
    able = chunks.where(not_parent() & F.col("model").isNotNull() & F.coalesce(F.length(F.trim("text")) >= least, F.lit(False)))
    return nearest(able, "id", "embedding", queries, "query_id", "vector", limit, size, threshold=scoring.THRESHOLDS.get(mode))


def strong(results: DataFrame, group: str, item: str, score: str, threshold: float, gate: Column, first: int = 3) -> DataFrame:
    """results of at least the threshold where the gate (such as a sure factual question) holds; a group that keeps none, its first ones. Elsewhere all stay."""
    w = Window.partitionBy(group)
    fits = F.coalesce(F.col(score) >= threshold, F.lit(False))
    rows = results.withColumns({"__n": F.row_number().over(w.orderBy(F.col(score).desc_nulls_last(), item)), "__any": F.max(fits).over(w)})
    return rows.where(~F.coalesce(gate, F.lit(False)) | F.when(F.col("__any"), fits).otherwise(F.col("__n") <= first)).drop("__n", "__any")


def _list_words(keywords: Column) -> Column:
    """The words by which keywords list chunks: each as it is, and its words of three characters and more."""
    return F.array_distinct(F.flatten(F.transform(keywords, lambda k: F.concat(F.array(F.lower(k)), F.filter(F.split(F.lower(k), r"\s+"), lambda w: F.length(w) > 2)))))


def _plain_words() -> Column:
    """The words of a chunk's text, and its context keywords."""
    return F.array_distinct(F.concat(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), F.transform(F.coalesce("context_keywords", F.array().cast("array<string>")), F.lower)))


def keyword_matches(chunks: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """query_id, id of the chunks that hold any keyword of a query as a word or a context keyword: all, or, for parity with the reference, the first `limit` by id.

    chunks: id, text, context_keywords; queries: query_id, keywords. An equi-join over words: only
    (word, id) pairs are shuffled, never texts.
    """
    asked = queries.select("query_id", F.explode(_list_words(F.col("keywords"))).alias("word"))
    wanted = asked.select("word").distinct()
    listed = chunks.select("id", F.explode(_plain_words()).alias("word")).join(wanted, "word", "left_semi")
    if limit is None:
        return asked.join(listed, "word").select("query_id", "id").distinct()
    # the first ids of a query are among the first of its words, so lists are cut before they meet queries
    first = Window.partitionBy("word").orderBy("id")
    short = listed.distinct().withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= limit).drop("__n")
    found = asked.join(short, "word").select("query_id", "id").distinct()
    w = Window.partitionBy("query_id").orderBy("id")
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= limit).drop("__n")


def expanded_keywords(keywords: Column, phrases: dict[str, list[str]] | None = None) -> Column:
    """Keywords in small letters, their words of three characters and more, and what those that equal a phrase of the caller's map stand for."""
    low = F.transform(keywords, F.lower)
    out = [F.flatten(F.transform(low, lambda k: F.concat(F.array(k), F.filter(F.split(k, r"\s+"), lambda w: F.length(w) > 2))))]
    for phrase, values in (phrases or {}).items():
        out.append(F.when(F.array_contains(low, phrase.lower()), F.array(*(F.lit(v.lower()) for v in values))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*out))


def keyword_features(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, needle, tf, in_url of each pair (id, needle) whose needle occurs in the chunk's text (tf times, maybe within an address) or context keywords (tf 0 if only there).

    Pairs are distinct first, so a chunk and a word are looked at once, however many queries ask for them, and no others are.
    """
    low = chunks.select("id", F.lower("text").alias("__t"), F.transform("context_keywords", F.lower).alias("__k"))
    joined = pairs.select("id", "needle").where("trim(needle) <> ''").distinct().join(low, "id")
    tf = F.coalesce(scoring.occurrences(F.col("__t"), F.col("needle")), F.lit(0))
    held = F.coalesce(F.exists("__k", lambda k: k.contains(F.col("needle"))), F.lit(False))
    urls = F.regexp_extract_all("__t", F.lit(r"https?://\S+|\b[\w-]+\.[\w.-]+\.\w{2,}\b"), F.lit(0))
    found = joined.select("id", "needle", "__t", tf.alias("tf"), held.alias("held")).where("tf > 0 or held")
    rated = found.select("id", "needle", "tf", F.when(F.col("tf") > 0, F.exists(urls, lambda u: u.contains(F.col("needle")))).otherwise(False).alias("in_url"))
    return rated.groupBy("id", "needle").agg(F.max("tf").alias("tf"), F.max("in_url").alias("in_url"))


#: Queries with the same keywords that a task scores, and words up to which a table of them goes to every task.
SAME_QUERIES, MOST_WORDS = 4096, 50_000
_ADDRESS = r"https?://\S+|\b[\w-]+\.[\w.-]+\.\w{2,}\b"


def _small(df: DataFrame) -> DataFrame:
    """df for a join, sent to every task if it is a small table of words."""
    return F.broadcast(df) if df.count() <= MOST_WORDS else df


def _facts(able: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """A row per chunk: n (in the order of ids), id, its length in words (len), whether it counts (ok), the needles that it holds (hits: needle, tf, in_url) and the words that list it (words).

    Each text is read once, whatever the number of queries, and isn't shuffled.
    """
    none = {"len": F.lit(None).cast("int"), "ok": F.lit(None).cast("boolean"), "hit": F.lit(None).cast("struct<needle:string,tf:int,in_url:boolean>"), "word": F.lit(None).cast("string")}
    row = lambda df, **c: df.select("id", *(c.get(n, v).alias(n) for n, v in none.items()))
    hit = lambda tf, url: F.struct("needle", tf.cast("int").alias("tf"), url.alias("in_url"))
    needles = sets.select(F.explode("needles").alias("needle"))
    urls = F.exists(F.regexp_extract_all("text", F.lit(_ADDRESS), F.lit(0)), lambda u: u.contains(F.col("needle")))
    said = contains(needles, able.select("id", "text"), tf=scoring.occurrences(F.col("text"), F.col("needle")), url=urls)
    # keywords are joined for one reading and taken apart where there is a hit
    held = contains(needles, able.select("id", F.array_join(F.transform("context_keywords", F.lower), "\x1f").alias("text")), own=F.exists(F.split("text", "\x1f"), lambda k: k.contains(F.col("needle"))))
    wanted = sets.select(F.explode("words").alias("word")).distinct()
    listed = able.where(F.col("text_length") >= least).select("id", F.explode(_plain_words()).alias("word")).join(_small(wanted), "word", "left_semi")
    parts = row(able, len=F.size(F.split("text", r"\s+")), ok=F.coalesce(meaningful(F.col("text"), least), F.lit(False)))
    parts = parts.unionByName(row(said, hit=hit(F.col("tf"), F.col("url")))).unionByName(row(held.where("own"), hit=hit(F.lit(0), F.lit(False)))).unionByName(row(listed, word=F.col("word")))
    made = parts.where("id is not null").groupBy("id").agg(F.max("len").alias("len"), F.max("ok").alias("ok"), F.collect_list("hit").alias("h"), F.collect_set("word").alias("words"))
    of = lambda x, f: F.array_max(F.transform(F.filter("h", lambda y: y["needle"] == x), lambda y: y[f]))
    hits = F.transform(F.array_distinct(F.transform("h", lambda y: y["needle"])), lambda x: F.struct(x.alias("needle"), of(x, "tf").alias("tf"), of(x, "in_url").alias("in_url")))
    return cut(made.orderBy("id").select(F.monotonically_increasing_id().alias("n"), "id", "len", "ok", hits.alias("hits"), "words"))


def _profile() -> list[Column]:
    """What a chunk's keyword score for a set of keywords depends on, besides the mean length."""
    own = F.filter("hits", lambda h: F.array_contains(F.col("needles"), h["needle"]))
    return ["len", "ok", F.array_sort(F.transform(own, lambda h: h["tf"])).alias("tfs"), F.exists(own, lambda h: h["in_url"]).alias("url")]


def _ranker(limit: int, mode: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best candidates of queries with the same keywords: their near chunks (right), and the chunks that the keywords list (left), by classes of equal scores."""
    wv, wk, wanted, _ = scoring.MODES[mode]

    def table_of(lists: pa.ChunkedArray) -> np.ndarray:
        """Frequencies, a row for each chunk, filled up with -1."""
        flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        n = np.diff(flat.offsets.to_numpy())
        out = np.full((len(n), max(1, n.max(initial=0))), -1.0)
        out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = flat.flatten().to_numpy(zero_copy_only=False)
        return out

    def points(tf: np.ndarray, size: np.ndarray, url: np.ndarray, mean: np.ndarray) -> np.ndarray:
        """Keyword scores; tf has a row for each chunk, the others broadcast."""
        n = (tf >= 0).sum(axis=1)
        rest = scoring.K1 * (1 - scoring.B + scoring.B * size / mean)  # more than 0 for a length
        total = np.zeros(np.broadcast_shapes(rest.shape, n.shape))
        for t in tf.T:
            total += np.where(t > 0, t * (scoring.K1 + 1) / (np.maximum(t, 0) + rest), 0.0)
        return np.where(n >= wanted, total + 0.5 * n + 2.0 * url, 0.0)

    def scaled(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.where(high == low, 1.0, (x - low) / np.where(high == low, 1.0, high - low))

    def numbers(t: pa.Table, c: str, kind: type = float) -> np.ndarray:
        return t.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(kind)

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([right.schema.field("query_id"), ("n", pa.int64()), ("vector_score", pa.float64()), ("keyword_score", pa.float64()), ("hybrid_score", pa.float64()), ("rank", pa.int32())])
        if right.num_rows == 0:
            return schema.empty_table()
        coded = right.column("query_id").combine_chunks().dictionary_encode()
        q, count = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
        add = lambda x: np.bincount(near_q, weights=x, minlength=count)
        # near chunks
        right = right.set_column(right.schema.get_field_index("query_id"), "q", pa.array(q))
        right = right.filter(pa.compute.is_valid(right.column("n")))
        near_q, near_n, vs, size, ok = numbers(right, "q", int), numbers(right, "n", np.int64), numbers(right, "vs"), numbers(right, "len"), numbers(right, "ok", bool)
        tf, url, overlap = table_of(right.column("tfs")), numbers(right, "url", bool), numbers(right, "overlap", bool)
        # listed chunks, in classes; where some chunk of a query counts, the others drop out
        p_ok = numbers(left, "ok", bool)
        last = numbers(left, "last", np.int64).max(initial=-1)
        any_ok = p_ok.any() | (add(ok) > 0)
        if p_ok.any():
            left = left.filter(pa.array(p_ok))
            uses = np.ones(count, bool)
        else:
            uses = ~any_ok if left.num_rows else np.zeros(count, bool)
        p_count, p_size, p_url, p_tf = numbers(left, "count"), numbers(left, "len"), numbers(left, "url", bool), table_of(left.column("tfs"))
        p_ns = [np.array(x, np.int64) for x in left.column("ns").to_pylist()]
        kept = ok | ~any_ok[near_q]
        near_q, near_n, vs, size, tf, url, listed = near_q[kept], near_n[kept], vs[kept], size[kept], tf[kept], url[kept], (overlap & (near_n <= last))[kept]
        known, p_known = ~np.isnan(size), ~np.isnan(p_size)
        total = uses * (p_count * np.where(p_known, p_size, 0)).sum() + add(np.where(known & ~listed, size, 0))
        mean = total / np.maximum(1, uses * (p_count * p_known).sum() + add(known & ~listed))
        mean = np.where(mean > 0, mean, 1.0)  # without lengths there are no frequencies either
        alone = uses * p_count.sum() - add(listed)
        ks = points(tf, np.where(known, size, 1), url, mean[near_q])
        low, high = [np.where(alone > 0, 0.01, np.inf), np.full(count, np.inf)], [np.where(alone > 0, 0.01, -np.inf), np.full(count, -np.inf)]
        for i, x in enumerate((vs, ks)):
            np.minimum.at(low[i], near_q, x)
            np.maximum.at(high[i], near_q, x)
        skipped: dict[int, list[int]] = {}
        for i, n in zip(near_q[listed].tolist(), near_n[listed].tolist()):
            skipped.setdefault(i, []).append(n)
        out = []
        some = np.flatnonzero(uses) if len(p_count) else np.zeros(0, int)
        for i in range(0, len(some), 64):
            at = some[i : i + 64]
            own = points(p_tf, np.where(p_known, p_size, 1)[None, :], p_url[None, :], mean[at][:, None])
            low[1][at], high[1][at] = np.minimum(low[1][at], own.min(axis=1)), np.maximum(high[1][at], own.max(axis=1))
            score = wv * scaled(np.full((len(at), 1), 0.01), low[0][at][:, None], high[0][at][:, None]) + wk * scaled(own, low[1][at][:, None], high[1][at][:, None])
            r = np.round(score, 9)
            for j in np.flatnonzero(alone[at] > 0):
                gone = skipped.get(int(at[j]), [])
                # each class has a chunk at least, so these classes hold the best ones
                want = min(limit + len(gone), r.shape[1])
                best = np.flatnonzero(r[j] >= np.partition(r[j], r.shape[1] - want)[r.shape[1] - want])
                rows = [p_ns[c][: limit + len(gone)] for c in best]
                n, c = np.concatenate(rows), np.repeat(best, [len(x) for x in rows])
                fresh = ~np.isin(n, gone)
                n, c = n[fresh], c[fresh]
                order = np.lexsort((n, -r[j][c]))[:limit]
                out.append((np.full(len(order), at[j]), n[order], np.full(len(order), 0.01), own[j][c[order]], score[j][c[order]]))
        hybrid = wv * scaled(vs, low[0][near_q], high[0][near_q]) + wk * scaled(ks, low[1][near_q], high[1][near_q])
        out.append((near_q, near_n, vs, ks, hybrid))
        q, n, vs, ks, hybrid = (np.concatenate(c) for c in zip(*out))
        order = np.lexsort((n, -np.round(hybrid, 9), q))
        place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
        order, place = order[place < limit], place[place < limit]
        return pa.table([coded.dictionary.take(pa.array(q[order].astype(np.int64))), pa.array(n[order].astype(np.int64)), *(pa.array(x[order].astype(float)) for x in (vs, ks, hybrid)), pa.array((place + 1).astype(np.int32))], schema=schema)

    return rank


def hybrid_search(
    chunks: DataFrame, queries: DataFrame, limit: int = 10, mode: str = "balanced", size: int = 96, least: int = 80, keyword_limit: int | None = None, phrases: dict[str, list[str]] | None = None, shown: dict[str, Column] | None = None,
) -> DataFrame:
    """query_id, id, vector_score, keyword_score, hybrid_score, rank, text (with the parent's) of the best chunks of each query; shown: other columns made of a chunk's than text.

    chunks: id, text, parent_text, context_keywords, embedding, level, text_length; queries: query_id, vector, keywords.
    Chunks delivered repeatedly under one id count once. All chunks with a keyword are scored before the best are
    kept; keyword_limit (500 in the reference) scores only the first by id.

    Per query: short candidates drop out unless all are; matched keywords give a saturated frequency score, half a
    point each and two for one within an address; both scores are scaled to 0..1 over the candidates.
    Queries with the same keywords list the same chunks. These are counted in classes that always score alike (length, frequencies, address), each
    with its first ids, so queries meet classes and not all chunks; only a query's near chunks are rows of its own.
    """
    able, more = chunks.where(not_parent()), limit * scoring.MODES[mode][3]
    asked, sets, facts = prepared(able, queries, size, least, phrases, listing=mode != "precise")
    near = near_lists(able, asked, facts, more, size)
    return ranked(able, sets, facts, near, asked.select("qid.*"), limit, mode, keyword_limit, shown)


def prepared(able: DataFrame, queries: DataFrame, size: int, least: int = 80, phrases: dict[str, list[str]] | None = None, listing: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a hybrid search needs: queries (qid: query_id, set and part of it; v), sets of keywords (kid, parts, k, words, needles), and the facts of chunks."""
    low = F.coalesce(F.array_sort(F.array_distinct(F.transform("keywords", F.lower))), F.array().cast("array<string>"))
    said = queries.where("query_id is not null").select("query_id", low.alias("k"), F.when(vectors.valid(F.col("vector"), size), F.col("vector")).alias("v"))
    asked = cut(said.groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("k")))).alias("k"), F.first("v", ignorenulls=True).alias("v")).withColumn("kid", F.to_json("k")))
    empty = F.array().cast("array<string>")
    sets = asked.groupBy("kid").agg(F.first("k").alias("k"), F.ceil(F.count("*") / SAME_QUERIES).cast("int").alias("parts"))
    words = F.coalesce(_list_words(F.col("k")), empty) if listing else empty
    sets = cut(sets.select("kid", "parts", "k", words.alias("words"), F.coalesce(expanded_keywords(F.col("k"), phrases), empty).alias("needles")))
    # (query, set, part) goes along with the query's near chunks
    own = asked.join(_small(sets.select("kid", "parts")), "kid").select(F.struct("query_id", "kid", F.pmod(F.xxhash64("query_id"), "parts").cast("int").alias("part")).alias("qid"), "v")
    return own, sets, _facts(able, sets, least)


def near_lists(able: DataFrame, asked: DataFrame, facts: DataFrame, k: int, size: int) -> DataFrame:
    """query_id, kid, part, ns, vs: the numbers and similarities of the k nearest chunks of each query, in order; a query without any has no row."""
    packed = _vectors_of(able, "id", "embedding", size).join(facts.select("id", "n"), "id").select(F.col("n").alias("id"), "v")
    return _nearest_of(packed, asked, k, size, shared=True).select("qid.*", F.col("ids").alias("ns"), F.col("scores").alias("vs"))


def ranked(able: DataFrame, sets: DataFrame, facts: DataFrame, near: DataFrame, asked: DataFrame, limit: int, mode: str, keyword_limit: int | None = None, shown: dict[str, Column] | None = None) -> DataFrame:
    """The result of hybrid_search for the queries asked (query_id, kid, part) from their near chunks (near_lists)."""
    more, known = limit * scoring.MODES[mode][3], _small(sets)
    set_words = known.select("kid", "needles", F.col("words").alias("set_words"))
    near = near.select("query_id", "kid", "part", F.explode(F.arrays_zip("ns", "vs")).alias("x")).select("query_id", "kid", "part", F.col("x.ns").alias("n"), "x.vs")
    near = near.join(facts.drop("id"), "n").join(set_words, "kid").select("kid", "part", "query_id", "n", "vs", *_profile(), F.coalesce(F.arrays_overlap("words", "set_words"), F.lit(False)).alias("overlap"))
    # a query without near chunks has a row too
    near = near.unionByName(asked, allowMissingColumns=True)

    listed = facts.select("n", "len", "ok", "hits", F.explode("words").alias("word"))
    if keyword_limit is not None:
        # the first ids of a query are among the first of its words
        listed = listed.withColumn("__n", F.row_number().over(Window.partitionBy("word").orderBy("n"))).where(F.col("__n") <= keyword_limit)
    by_word = _small(sets.select("kid", "needles", F.explode("words").alias("word")))
    listed = listed.join(by_word, "word").select("kid", "n", F.struct(*_profile()).alias("p")).dropDuplicates(["kid", "n"])
    if keyword_limit is not None:
        listed = listed.withColumn("__n", F.row_number().over(Window.partitionBy("kid").orderBy("n"))).where(F.col("__n") <= keyword_limit)
    alike = Window.partitionBy("kid", "p")
    first = listed.withColumns({"__r": F.row_number().over(alike.orderBy("n")), "count": F.count("*").over(alike), "last": F.max("n").over(alike)}).where(F.col("__r") <= limit + more)
    classes = first.groupBy("kid", "p").agg(F.max("count").alias("count"), F.max("last").alias("last"), F.array_sort(F.collect_list("n")).alias("ns"))  # limit + more at most
    classes = classes.join(known.select("kid", "parts"), "kid").select("kid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "p.*", "count", "last", "ns")

    q_type = asked.schema["query_id"].dataType.simpleString()
    top = classes.groupBy("kid", "part").cogroup(near.groupBy("kid", "part")).applyInArrow(_ranker(limit, mode), f"query_id {q_type}, n long, vector_score double, keyword_score double, hybrid_score double, rank int")
    full = top.join(facts.select("n", "id"), "n")
    columns = {"text": F.concat_ws(" ", "text", "parent_text")} if shown is None else shown
    if columns:
        # made before anything is joined, so of a text that isn't shown nothing is shuffled
        once = able.select("id", *(c.alias(n) for n, c in columns.items())).groupBy("id").agg(*(F.first(n).alias(n) for n in columns))
        full = full.join(once, "id")
    return full.select("query_id", "id", "vector_score", "keyword_score", "hybrid_score", "rank", *columns)


def reciprocal_rank_fusion(lists: DataFrame, group: str, list_id: str, item: str, score: str, k: int = 60) -> DataFrame:
    """group, item, fused: the sum over the group's lists of 1 / (k + place); ties in a list by item."""
    w = Window.partitionBy(group, list_id).orderBy(F.col(score).desc_nulls_last(), item)
    placed = lists.withColumn("__p", F.row_number().over(w))
    return placed.groupBy(group, item).agg(F.sum(1.0 / (k + F.col("__p"))).alias("fused"))


def merge_secondary(primary: DataFrame, secondary: DataFrame, group: str, item: str, score: str, k: int = 60, weight: float = 0.9) -> DataFrame:
    """primary scores plus weight / (k + 1) times the secondary ones; items only in secondary are added."""
    parts = primary.select(group, item, F.col(score).alias("s")).unionByName(secondary.select(group, item, (F.col(score) * weight / (k + 1)).alias("s")))
    return parts.groupBy(group, item).agg(F.sum("s").alias(score))


def expand_parents(results: DataFrame, parents: DataFrame, group: str, order: str, most: int = 6000) -> DataFrame:
    """One row per parent of a group (its text, then its distinct children in order, cut to `most` characters); rows without a parent as they are.

    results: group, id, text, parent_id, parent_text, order; parents: chunk_id, text. A parent has few
    children within one result list, which bounds what is collected.
    """
    own = parents.select(F.col("chunk_id").alias("parent_id"), F.col("text").alias("__p"))
    alone = results.where("parent_id is null").select(group, F.col("id"), F.lit(None).cast("string").alias("parent_id"), F.col("text"), F.col(order).alias("first"))
    kids = results.where("parent_id is not null").groupBy(group, "parent_id").agg(
        F.min_by("id", order).alias("id"), F.min(order).alias("first"), F.min_by("parent_text", order).alias("__t"),
        F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]).alias("__c"),
    )
    joined = kids.join(own, "parent_id", "left").withColumn("__b", F.coalesce("__p", "__t", F.lit("")))
    children = F.array_join(F.array_distinct("__c"), "\n\n")
    body = F.when(F.col("__b") != "", F.concat("__b", F.lit("\n\n"), children)).otherwise(children)
    return joined.select(group, "id", "parent_id", F.left(body, F.lit(most)).alias("text"), "first").unionByName(alone)


def entity_filter(results: DataFrame, groups: Column, group: str, order: list[Column], limit: int) -> DataFrame:
    """Three tiers per query: rows that hold a spelling of every name; else of the last name; else the first `limit` rows, flagged as fallback."""
    low = F.lower("text")
    latin = text.to_latin(F.col("text"))
    hit = F.transform(groups, lambda g: F.exists(g, lambda v: low.contains(v) | latin.contains(v)))
    rows = results.withColumn("__hit", hit)
    every, last = F.forall("__hit", lambda h: h), F.coalesce(F.try_element_at("__hit", F.lit(-1)), F.lit(False))
    w = Window.partitionBy(group)
    rows = rows.withColumns({"__every": every, "__last": last, "__n": F.row_number().over(w.orderBy(*order))})
    rows = rows.withColumns({"__any": F.max("__every").over(w), "__some": F.max("__last").over(w)})
    kept = F.when(F.col("__any"), F.col("__every")).when(F.col("__some"), F.col("__last")).otherwise(F.col("__n") <= limit)
    return rows.where(kept).withColumn("fallback", ~F.col("__any") & ~F.col("__some")).drop("__hit", "__every", "__last", "__n", "__any", "__some")


def image_search(images: DataFrame, queries: DataFrame, limit: int = 10, least: float = 0.0) -> DataFrame:
    """query_id, id, score: similarity, raised by 0.2 for each wanted word near a keyword and moved by 0.2 by excluded words.

    images: query_id, id, keywords, score (candidates); queries: query_id, include, exclude.
    """
    rows = images.join(queries, "query_id")
    kws = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), F.lower)
    rows = rows.withColumn("__k", kws)
    barred = F.exists("exclude", lambda e: F.array_contains(F.col("__k"), F.lower(e)))
    base = F.when(F.size("exclude") == 0, F.col("score")).when(barred, F.greatest(F.lit(0.0), F.col("score") - 0.2)).otherwise(F.least(F.lit(1.0), F.col("score") + 0.2))
    hits = F.size(F.filter("include", lambda i: F.exists("__k", lambda k: k.contains(F.lower(i)) | (F.levenshtein(k, F.lower(i)) <= 1))))
    scored = rows.withColumn("score", base + 0.2 * hits).where(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", "id", "score", "rank")
