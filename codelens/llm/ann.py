"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise


#: Cells of a matrix of vectors by lists that is held at once.
CELLS = 1 << 22


@dataclass
class Settings:
    """Parameters of an index.

    ``list_rows`` is the mean length of a list, up to ``max_lists`` lists, which are broadcast; beyond that
    lists get longer.  The centroids and codebooks are fitted on about ``sample`` rows, or on ``rows_a_list``
    for each list if that is more, so on 131,072 at most; every row is indexed.
    A query reads its ``first`` nearest lists, and then the rest of a ``probe_share`` of all lists, or of
    ``probes`` if those are more, for what is as near as the ``k``-th found so far.  Vectors without any structure need the large share given here
    for a recall of 0.9, clustered ones a small one.  Lists are read in blocks of about ``block_rows`` vectors, of
    which ``rerank`` candidates are scored exactly for a query.  A task holds a block, and its queries pass by; only
    where they are more than ``block_queries`` is a block sent to more tasks than one.
    """

    k: int = 20
    sample: int = 16_384
    rows_a_list: int = 8
    list_rows: int = 24
    max_lists: int = 16_384
    first: int = 32
    probes: int = 64
    probe_share: float = 0.48
    parts: int = 16
    codes: int = 64
    rounds: int = 6
    rerank: int = 512
    block_rows: int = 4096
    block_queries: int = 262_144
    seed: int = 7


@dataclass
class Model:
    centroids: np.ndarray  # directions of the lists, kindred ones side by side
    lengths: np.ndarray  # mean length of a list's vectors
    codebooks: np.ndarray  # parts x codes x width


def _lloyd(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool = False) -> np.ndarray:
    """Centroids from a few rounds after starting at random rows, so that dense regions get more."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest_lists(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    return c


def _directions(x: np.ndarray, lists: int, s: Settings, rng: np.random.Generator) -> np.ndarray:
    """Centroids of unit vectors: some, and below each of them its share of the lists."""
    some = _lloyd(x, max(1, round(math.sqrt(lists))), s.rounds, rng, unit=True)
    near = nearest_lists(x, some)
    share = np.bincount(near, minlength=len(some)) * lists / len(x)
    wanted = np.maximum(1, np.diff(np.r_[0, np.round(np.cumsum(share)).astype(int)]))
    return np.concatenate([_lloyd(x[near == i], int(wanted[i]), s.rounds, rng, unit=True) for i in range(len(some)) if (near == i).any()])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, lists: int, s: Settings) -> Model:
    rng = np.random.default_rng(s.seed)
    unit = _unit(sample)
    directions = _directions(unit, lists, s, rng)
    near = nearest_lists(unit, directions)
    del unit
    n, length = np.bincount(near, minlength=len(directions)), np.linalg.norm(sample, axis=1)
    lengths = np.where(n > 0, np.bincount(near, length, len(directions)) / np.maximum(n, 1), length.mean())
    width = -(-sample.shape[1] // s.parts)
    books = []
    for i in range(s.parts):
        own = slice(i * width, (i + 1) * width)
        rest = sample[:, own] - directions[:, own][near] * lengths[near, None]
        book = _lloyd(np.pad(rest, ((0, 0), (0, width - rest.shape[1]))), s.codes, s.rounds, rng)
        books.append(np.pad(book, ((0, s.codes - len(book)), (0, 0)), mode="edge"))
    return Model(directions, lengths, np.stack(books))


def _some(rows: int, lists: int) -> Iterator[slice]:
    """Slices of rows, so that rows by lists are at most ``CELLS`` in each."""
    step = max(1, CELLS // max(1, lists))
    return (slice(i, i + step) for i in range(0, rows, step))


def nearest_lists(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out, own = np.empty(len(x), np.int64), (centroids * centroids).sum(1)
    for rows in _some(len(x), len(centroids)):
        far = x[rows] @ centroids.T
        far *= -2
        far += own
        out[rows] = far.argmin(axis=1)
    return out


def encode(x: np.ndarray, lists: np.ndarray, m: Model) -> np.ndarray:
    parts, codes, width = m.codebooks.shape
    rest = x - m.centroids[lists] * m.lengths[lists, None]
    rest = np.pad(rest, ((0, 0), (0, parts * width - rest.shape[1])))
    out = np.empty((len(x), parts), np.uint8)
    for i, book in enumerate(m.codebooks):
        out[:, i] = nearest_lists(rest[:, i * width : (i + 1) * width], book)
    return out


def _stacked(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy().reshape(len(whole), -1) if len(whole) else np.empty((0, 0))


def _matrix(rows: DataFrame) -> np.ndarray:
    """A bounded number of vectors as a matrix on the driver."""
    return _stacked(rows.toArrow().column("v"))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(vec_id, v)`` of the rows with a vector of finite components, not all zero, and an id."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    return rows.where(~bad & F.exists("v", lambda x: x != 0))


class Block:
    """Vectors of some lists, by id, with their lists and codes."""

    def __init__(self, rows: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(rows)
        self.ids, self.x = t.column("id").to_numpy(), _stacked(t.column("v"))
        self.code = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(self.ids), -1)
        self.lists, self.slot = np.unique(t.column("list").to_numpy(), return_inverse=True)


def search(vectors: DataFrame, every: int = 20, settings: Settings | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for the rows whose id is divisible by ``every`` the ``k`` of
    largest inner product among the other rows, in order, ties to the smaller id.

    Every usable row is in the index; scores are exact inner products of the original vectors.  Vectors that
    are null, all zero, or hold a null or non-finite component take no part, nor do rows without an id, nor
    vectors of another length than most have (of equally frequent lengths the least).  Equal vectors under
    different ids are found apart; of rows that repeat an id the one with the smallest vector counts.
    """
    s = settings or Settings()
    rows = usable(vectors, id_col, vec_col)
    width = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if not width:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == width.w)
    rows = materialise(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    n = rows.count()
    lists = max(1, min(s.max_lists, n // s.list_rows))
    some = max(s.sample, s.rows_a_list * lists)
    share = min(1.0, some / n)
    chosen = rows.where((F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))).select("v").limit(2 * some) if share < 1 else rows.select("v")
    sample = _matrix(chosen)
    if not len(sample):
        sample = _matrix(rows.limit(some).select("v"))
    fitted = fit(sample, lists, s)
    lists = len(fitted.centroids)
    model = rows.sparkSession.sparkContext.broadcast(fitted)
    first = min(lists, s.first)
    probes = min(lists, max(first, s.probes, math.ceil(s.probe_share * lists)))
    together = max(1, s.block_rows // s.list_rows)  # lists that are read together

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            if b.num_rows:
                x = _stacked(b.column(1))
                near = nearest_lists(_unit(x), m.centroids)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array([c.tobytes() for c in encode(x, near, m)], pa.binary())], ["vec_id", "v", "list", "code"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block of lists that a query reads at first, and for each that it reads then."""
        m = model.value
        directed = (m.centroids * m.lengths[:, None]).T
        for whole in batches:
            for rows in _some(whole.num_rows, lists):
                b = whole.slice(rows.start, rows.stop - rows.start)
                x = _stacked(b.column(1))
                near = np.argsort(-(x @ directed), axis=1, kind="stable")
                for early, best in ((True, near[:, :first]), (False, near[:, first:probes])):
                    if not best.shape[1]:
                        continue
                    pair = np.sort(best, axis=1)
                    group = pair // together
                    new = np.c_[np.ones(len(pair), bool), group[:, 1:] != group[:, :-1]].ravel()
                    at = np.flatnonzero(new)
                    row = pa.array(at // pair.shape[1])
                    read = pa.ListArray.from_arrays(pa.array(np.r_[at, len(new)].astype(np.int32)), pa.array(pair.ravel().astype(np.int32)))
                    yield pa.record_batch([b.column(0).take(row), b.column(1).take(row), pa.array(group.ravel()[at].astype(np.int32)), read, pa.array(np.full(len(at), early))], ["query_id", "q", "group", "lists", "early"])

    index = materialise(rows.mapInArrow(assign, "vec_id long, v array<double>, list int, code binary"), "index")
    index = index.withColumn("group", F.floor(F.col("list") / together).cast("int"))
    asked = materialise(rows.where(F.col("vec_id") % every == 0).mapInArrow(probe, "query_id long, q array<double>, group int, lists array<int>, early boolean"), "probes")

    def score(block: Block, asking: np.ndarray, y: np.ndarray, lists_read: list, least: np.ndarray) -> tuple[np.ndarray, ...]:
        """The queries' nearest of a block: by quantised scores first, the best of these exactly."""
        m, x, ids = model.value, block.x, block.ids
        parts, codes, width = m.codebooks.shape
        some_n = min(s.rerank, len(ids))
        padded = np.pad(y, ((0, 0), (0, parts * width - y.shape[1]))).reshape(len(y), parts, width)
        tables = np.einsum("pcw,qpw->qpc", m.codebooks, padded).astype(np.float32)  # asymmetric: queries stay whole
        near = (y @ (m.centroids[block.lists] * m.lengths[block.lists, None]).T).astype(np.float32)
        for i, some in enumerate(lists_read):
            near[i, ~np.isin(block.lists, some)] = -np.inf
        near = near[:, block.slot]
        for j in range(parts):
            near += tables[:, j, :][:, block.code[:, j]]
        own = np.minimum(np.searchsorted(ids, asking), len(ids) - 1)
        near[np.flatnonzero(ids[own] == asking), own[ids[own] == asking]] = -np.inf
        best = np.sort(np.argpartition(-near, some_n - 1, axis=1)[:, :some_n], axis=1)
        exact = np.einsum("qrd,qd->qr", x[best], y)
        exact[np.isinf(np.take_along_axis(near, best, axis=1))] = -np.inf
        top = np.argsort(-exact, axis=1, kind="stable")[:, : s.k]  # places follow ids, so ties do
        found = np.take_along_axis(exact, top, axis=1)
        good = np.isfinite(found) & (found >= least[:, None])
        return np.repeat(asking, good.sum(axis=1)), ids[np.take_along_axis(best, top, axis=1)][good], found[good]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows: a block's vectors, which are held, then the queries that read it, which pass by."""
        key, held, block = None, [], None
        for b in batches:
            marks = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1).astype(np.int64)
            edges = np.r_[0, np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1, len(marks)]
            for at, end in zip(edges[:-1], edges[1:], strict=True):
                part = b.slice(at, end - at)
                if tuple(marks[at, :3]) != key:
                    key, held, block = tuple(marks[at, :3]), [], None
                if not marks[at, 3]:
                    held.append(part)
                    continue
                if not held:
                    continue
                block = block or Block(held)
                for i in range(0, len(part), 128):
                    q = part.slice(i, 128)
                    out = score(block, q.column("id").to_numpy(), _stacked(q.column("v")), q.column("lists").to_pylist(), q.column("least").to_numpy())
                    yield pa.record_batch([pa.array(c) for c in out], ["query_id", "vec_id", "score"])

    def read(queries: DataFrame) -> DataFrame:
        """Rows near ``queries(query_id, q, group, lists, least)``, of a score of ``least`` or more."""
        # Long groups of lists are dealt in blocks; what reads one is cut only where a task would be long.
        blocks = index.groupBy("group").agg(F.ceil(F.count("*") / s.block_rows).cast("int").alias("vb"))
        blocks = blocks.join(queries.groupBy("group").agg(F.ceil(F.count("*") / s.block_queries).cast("int").alias("qb")), "group")
        blocks = F.broadcast(blocks)  # at most max_lists rows
        none = lambda kind: F.lit(None).cast(kind)
        left = index.join(blocks, "group").withColumn("vb", F.pmod(F.xxhash64("vec_id"), F.col("vb")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
        right = queries.join(blocks, "group").withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("qb")).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)))
        keys = ["group", "vb", "qb"]
        stored = left.select(*keys, F.lit(0).alias("asks"), F.col("vec_id").alias("id"), "v", "list", "code", none("array<int>").alias("lists"), none("double").alias("least"))
        asking = right.select(*keys, F.lit(1).alias("asks"), F.col("query_id").alias("id"), F.col("q").alias("v"), none("int").alias("list"), none("binary").alias("code"), "lists", "least")
        dealt = stored.unionByName(asking).repartition(*keys).sortWithinPartitions(*keys, "asks", "id")
        return dealt.mapInArrow(scan, "query_id long, vec_id long, score double")

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= s.k)
    lowest = F.lit(float("-inf"))
    near = materialise(best(read(asked.where("early").withColumn("least", lowest))), "near")
    kth = near.where(F.col("rank") == s.k).select("query_id", F.col("score").alias("least"))
    then = asked.where("NOT early").join(kth, "query_id", "left").withColumn("least", F.coalesce("least", lowest))
    found = best(near.drop("rank").unionByName(read(then)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
