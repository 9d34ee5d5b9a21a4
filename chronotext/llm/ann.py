"""Approximate nearest neighbours: score-aware anisotropic product quantisation, four-bit table scans, exact reranking.

The nearest vectors x of a query q are those of the largest q.x - |x|^2 / 2. q.x is estimated from codes: the vector is
cut in subspaces, each with 16 centres, and codes and centres minimise a loss in which the part of the residual that is
parallel to x, which is what distorts large inner products, costs `eta` times the part across it; |x|^2 is kept exactly.
Two four-bit codes make a byte, and a scan adds one entry of a table of 256 per byte and query. Equal vectors of a batch
are one node. Of each batch the nodes of the best estimates are measured exactly, in double precision: a fixed share of
them, at least 4 k, and all that tie with the last of these; of copies and of vectors of one code none is left out alone. A
partition hands on its `k` nearest of each query. The tests hold the recall on the tables at hand against brute force.

Centres are fitted on at most `sample` vectors; every vector is indexed and every query scans all of them. Queries are
taken in blocks of bounded size.

Defined results: vectors that are null, empty, zero, of another dimension than most of the sample, or hold null or
non-finite components take no part, neither do null ids; a repeated id counts once, at its nearest vector; a query with
fewer candidates than k gets them all; equal distances go by the smaller id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import unit_hash, written

SAMPLE, QUERY_BLOCK = 20_000, 4096
#: The share of a batch's nodes that is measured, and how many times k at least.
RERANK, LEAST = 0.06, 4
SUBSPACE = 2
#: Inner products of at least this cosine matter: eta = (d - 1) t^2 / (1 - t^2).
THRESHOLD = 0.2


def valid(vector: str) -> F.Column:
    return F.expr(f"{vector} IS NOT NULL AND size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists({vector}, x -> x <> 0)")


@dataclass
class Codebook:
    """Centres (subspaces x 16 x dimensions of one), and how vectors are coded by them."""

    centres: np.ndarray
    dimension: int
    eta: float

    def _cut(self, x: np.ndarray) -> np.ndarray:
        m, _, d = self.centres.shape
        out = np.zeros((len(x), m * d), np.float32)
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, d)

    def _parts(self, x: np.ndarray):
        cut = self._cut(x)
        unit = cut / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None]
        return cut, unit

    def encode(self, x: np.ndarray, sweeps: int = 2, codes: np.ndarray | None = None) -> np.ndarray:
        """Codes of all vectors by coordinate descent on the anisotropic loss, a subspace at a time."""
        cut, unit = self._parts(x)
        m = len(self.centres)
        error, along = np.empty((m, len(x), 16), np.float32), np.empty((m, len(x), 16), np.float32)
        for j in range(m):
            error[j] = (cut[:, j] ** 2).sum(1)[:, None] - 2 * cut[:, j] @ self.centres[j].T + (self.centres[j] ** 2).sum(1)[None, :]
            along[j] = (cut[:, j] * unit[:, j]).sum(1)[:, None] - unit[:, j] @ self.centres[j].T
        if codes is None:
            codes = error.argmin(axis=2).T.astype(np.int64)
        row = np.arange(len(x))
        total = sum(along[j][row, codes[:, j]] for j in range(m)) if m else np.zeros(len(x))
        for _ in range(sweeps):
            for j in range(m):
                rest = total - along[j][row, codes[:, j]]
                codes[:, j] = (error[j] + (self.eta - 1) * (rest[:, None] + along[j]) ** 2).argmin(axis=1)
                total = rest + along[j][row, codes[:, j]]
        return codes

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """The centres of each subspace that minimise the loss of these codes, the other subspaces held."""
        cut, unit = self._parts(x)
        m, _, d = self.centres.shape
        along = np.stack([((cut[:, j] - self.centres[j][codes[:, j]]) * unit[:, j]).sum(1) for j in range(m)], 1)
        total = along.sum(1)
        for j in range(m):
            rest = total - along[:, j]
            for c in range(16):
                own = codes[:, j] == c
                if own.any():
                    u, v = unit[own, j].astype(np.float64), cut[own, j].astype(np.float64)
                    left = own.sum() * np.eye(d) + (self.eta - 1) * u.T @ u
                    right = v.sum(0) + (self.eta - 1) * (u * (rest[own] + (v * u).sum(1))[:, None]).sum(0)
                    self.centres[j, c] = np.linalg.solve(left, right)
            along[:, j] = ((cut[:, j] - self.centres[j][codes[:, j]]) * unit[:, j]).sum(1)
            total = rest + along[:, j]

    def decode(self, packed: np.ndarray) -> np.ndarray:
        """The vectors that packed codes stand for."""
        codes = np.stack([packed >> 4, packed & 15], 2).reshape(len(packed), -1)[:, : len(self.centres)]
        return self.centres[np.arange(len(self.centres)), codes].reshape(len(packed), -1)[:, : self.dimension].astype(np.float64)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte of a code the estimated inner product: queries x bytes x 256."""
        cut = self._cut(queries)
        one = np.einsum("qmd,mcd->qmc", cut, self.centres)
        if one.shape[1] % 2:
            one = np.concatenate([one, np.zeros((len(one), 1, 16), one.dtype)], 1)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(one), -1, 256).astype(np.float32)


#: Components beyond this are cut for codes and tables alone, never for distances.
MOST_SINGLE = 1e15


def single(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -MOST_SINGLE, MOST_SINGLE).astype(np.float32)


def pack(codes: np.ndarray) -> np.ndarray:
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], 1)
    return (codes[:, 0::2] * 16 + codes[:, 1::2]).astype(np.uint8)


def fit(x: np.ndarray, dimension: int, threshold: float = THRESHOLD, rounds: int = 8, seed: int = 1) -> Codebook:
    """A codebook from a sample of vectors."""
    random = np.random.default_rng(seed)
    m = -(-dimension // SUBSPACE)
    eta = max(1.0, (dimension - 1) * threshold**2 / (1 - threshold**2))
    book = Codebook(np.zeros((m, 16, SUBSPACE), np.float32), dimension, eta)
    cut = book._cut(x)
    for j in range(m):
        book.centres[j] = cut[random.choice(len(x), 16, replace=len(x) < 16), j] + random.normal(0, 1e-4, (16, SUBSPACE))
    plain, book.eta = book.eta, 1.0
    for r in range(rounds):
        book.eta = 1.0 if r < rounds // 2 else plain  # plain k-means first
        book.refit(x, book.encode(x, 1 if r >= rounds // 2 else 0))
    return book


def index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> tuple[DataFrame, Codebook | None]:
    """(id, vector, code) of every vector that takes part, as a table, and the codebook (None: no vector takes part)."""
    rows = vectors.where(valid(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    sizes = {r["d"]: r["n"] for r in rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return rows.withColumn("code", F.lit(b"")), None
    dimension = max(sizes, key=lambda d: (sizes[d], d))
    rows = rows.where(F.size("vector") == dimension)
    chosen = rows.where(unit_hash(F.col("id"), F.lit("ann")) < min(1.0, sample / sizes[dimension])) if sizes[dimension] > sample else rows
    x = single(chosen.limit(2 * sample).toArrow()["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, dimension)
    book = fit(x, dimension)
    shared = vectors.sparkSession.sparkContext.broadcast(book)

    def encode(batches):
        for batch in batches:
            x = single(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, dimension)
            codes = pack(np.concatenate([shared.value.encode(x[i : i + 4096]) for i in range(0, len(x), 4096)])) if len(x) else np.zeros((0, 1), np.uint8)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "vector", "code"])

    return written(rows.mapInArrow(encode, f"id long, vector {rows.schema['vector'].dataType.simpleString()}, code binary"), "ann-index"), book


class Nodes:
    """The distinct vectors of a batch, each with its k + 1 smallest ids: one of them may be the query's own."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codes: np.ndarray, k: int):
        x = np.ascontiguousarray(x + x.dtype.type(0))  # -0 and 0 are one value
        coded = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(x)]).dictionary_encode()
        node = coded.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, node))
        node, names = node[order], ids[order]
        fresh = np.ones(len(node), bool)
        fresh[1:] = (node[1:] != node[:-1]) | (names[1:] != names[:-1])
        node, names, order = node[fresh], names[fresh], order[fresh]
        begin = np.searchsorted(node, np.arange(len(coded.dictionary)))
        few = np.arange(len(node)) - begin[node] <= k
        rows = order[begin]
        self.names, self.count = names[few], np.bincount(node[few], minlength=len(begin))
        self.begin = np.cumsum(self.count) - self.count
        self.x, self.codes = x[rows].astype(np.float64), codes[:, rows]
        self.half = (self.x**2).sum(1) / 2
        _, self.code = np.unique(np.ascontiguousarray(self.codes.T).view(np.dtype((np.void, len(self.codes)))).ravel(), return_inverse=True)

    def nearer(self, best: tuple[np.ndarray, np.ndarray], found: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest distinct ids of `best` and the nodes `found`, without `own`, by exact distance."""
        distance = np.sqrt(((self.x[found] - q) ** 2).sum(1))
        count = self.count[found]
        ids = self.names[np.arange(count.sum()) + np.repeat(self.begin[found] - np.cumsum(count) + count, count)]
        a, d = np.concatenate([best[0], ids]), np.concatenate([best[1], np.repeat(distance, count)])
        order = np.lexsort((a, d))
        order = order[a[order] != own]
        _, first = np.unique(a[order], return_index=True)
        order = order[np.sort(first)][:k]
        return a[order], d[order]


def shortlist(estimate: np.ndarray, code: np.ndarray, k: int, rerank: float = RERANK) -> list[np.ndarray]:
    """Of each row of estimates the nodes to measure: the best, all that are as good as the last of them, and all that share
    a code with one of the best 2 k, which an estimate cannot tell apart."""
    n = estimate.shape[1]
    m = max(LEAST * k, k + 1, math.ceil(rerank * n))
    if m >= n:
        return [np.arange(n)] * len(estimate)
    last = -np.partition(-estimate, m - 1, axis=1)[:, m - 1]
    near = np.argpartition(-estimate, 2 * k - 1, axis=1)[:, : 2 * k]
    alike = np.zeros(code.max() + 1, bool)
    out = []
    for row, least, best in zip(estimate, last, near, strict=True):
        alike[code[best]] = True
        out.append(np.flatnonzero((row >= least) | alike[code]))
        alike[code[best]] = False
    return out


def search(indexed: DataFrame, book: Codebook | None, queries: DataFrame, k: int = 10, rerank: float = RERANK, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each of `queries` (id, vector)."""
    schema = "query_id long, vec_id long, score double"
    spark = indexed.sparkSession
    if book is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = queries.groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = max(1, math.ceil(queries.count() / block))

    def scan_for(ids: np.ndarray, q: np.ndarray):
        shared = spark.sparkContext.broadcast((ids, q, book))

        def scan(batches):
            ids, q, book = shared.value
            best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
            for batch in batches:
                n = batch.num_rows
                own = batch.column(0).to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, -1).T.copy()
                nodes = Nodes(own, x, codes, k)
                n = len(nodes.half)
                for i in range(0, len(ids), 64):
                    some = q[i : i + 64].astype(np.float64)
                    table = book.tables(single(q[i : i + 64]))
                    inner = np.zeros((len(table), n), np.float32)
                    for byte in range(len(nodes.codes)):
                        inner += np.take(table[:, byte], nodes.codes[byte], axis=1)
                    estimate = inner - nodes.half
                    estimate[np.abs(some).max(axis=1) > MOST_SINGLE] = np.inf  # beyond what tables hold: all are measured
                    for j, found in enumerate(shortlist(estimate, nodes.code, k, rerank), i):
                        best[j] = nodes.nearer(best[j], found, q[j].astype(np.float64), ids[j], k)
            for i in range(0, len(ids), 4096):
                some = best[i : i + 4096]
                yield pa.record_batch([pa.array(np.repeat(ids[i : i + 4096], [len(a) for a, _ in some])), pa.array(np.concatenate([a for a, _ in some])), pa.array(np.concatenate([d for _, d in some]))], ["query_id", "vec_id", "score"])

        return scan

    found = []
    for b in range(blocks):
        # a bounded block of queries against every partition of the index
        part = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        ids = part["id"].to_numpy()
        if len(ids):
            q = part["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            found.append(indexed.mapInArrow(scan_for(ids, q), schema))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    each = reduce(DataFrame.unionAll, found).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
