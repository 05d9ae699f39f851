"""Approximate nearest neighbours with score-aware anisotropic quantisation.

Vectors are turned so that the nearest by Euclidean distance has the largest inner
product: half the squared norm is one more component, and a query has -1 there.
Sixteen-entry codebooks, one for each group of components, are trained so that the
error along a vector, which changes large inner products most, weighs more than the
error across it. A search scans the four-bit codes through one table a query and
reranks the best of each partition by the exact distance.

Queries come in blocks of bounded size; each block is sent to all tasks, and every
task reads each code once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import saved, table

#: Rows that codebooks are trained on at most, by a hash of their id.
SAMPLE = 8192
#: Components of one code; rounds of training; weight of the error along a vector.
GROUP, ROUNDS, ALONG = 4, 8, 4.0
#: Queries of a block; candidates of a partition's batch that are reranked, for each result.
QUERY_BLOCK, RERANK = 4096, 48
#: Share of a batch's rows that is reranked at least, so that recall doesn't fall as batches grow.
RERANKED = 1 / 8
#: Largest component in codes, as a multiple of the sample's median; rows beyond it are reranked whatever their codes say.
LIMIT = float(1 << 20)


@dataclass
class Codebooks:
    """books: groups x 16 x GROUP, over `width` components and one for the norm, padded with zeros; `scale` is a power of two."""

    books: np.ndarray
    width: int
    scale: float = 1.0

    @property
    def groups(self) -> int:
        return len(self.books)

    def padded(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.groups * GROUP), np.float32)
        out[:, : self.width] = x
        out[:, self.width] = last
        return out

    def scaled(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(x * self.scale, -LIMIT, LIMIT)

    def wide(self, x: np.ndarray) -> np.ndarray:
        """Rows that codes can't tell apart, for their components are cut off."""
        return np.abs(x).max(axis=1, initial=0.0) > LIMIT / self.scale

    def rows(self, x: np.ndarray) -> np.ndarray:
        y = self.scaled(x)
        return self.padded(y, np.einsum("ij,ij->i", y, y) / 2)

    def queries(self, q: np.ndarray) -> np.ndarray:
        return self.padded(self.scaled(q), np.full(len(q), -1.0))

    def encode(self, x: np.ndarray, rounds: int = 2) -> np.ndarray:
        """Codes of padded rows; groups take turns, each knowing the others' error along the vector."""
        x = x.reshape(len(x), self.groups, GROUP)
        unit = x / np.maximum(np.linalg.norm(x.reshape(len(x), -1), axis=1), 1e-12)[:, None, None]
        codes = np.zeros((len(x), self.groups), np.uint8)
        for g in range(self.groups):
            codes[:, g] = ((x[:, g, None, :] - self.books[g]) ** 2).sum(axis=2).argmin(axis=1)
        left = x - self.books[np.arange(self.groups), codes]
        along = np.einsum("ngd,ngd->ng", left, unit)
        total = along.sum(axis=1)
        for _ in range(rounds):
            for g in range(self.groups):
                miss = x[:, g, None, :] - self.books[g]
                rest = (total - along[:, g])[:, None] + np.einsum("nkd,nd->nk", miss, unit[:, g])
                codes[:, g] = ((miss**2).sum(axis=2) + (ALONG - 1) * rest**2).argmin(axis=1)
                now = np.einsum("nd,nd->n", x[:, g] - self.books[g][codes[:, g]], unit[:, g])
                total += now - along[:, g]
                along[:, g] = now
        return codes


def train(x: np.ndarray, seed: int = 0) -> Codebooks:
    """Codebooks from rows of a bounded sample: assignment and weighted least squares in turn."""
    width = x.shape[1]
    groups = -(-(width + 1) // GROUP)
    rng = np.random.default_rng(seed)
    top = float(np.median(np.abs(x).max(axis=1)))
    made = Codebooks(np.zeros((groups, 16, GROUP), np.float32), width, 2.0 ** -np.clip(np.frexp(top)[1], -1000, 1000))
    rows = made.rows(x[~made.wide(x)])
    pick = rng.choice(len(rows), 16, replace=len(rows) < 16)
    made.books = rows[pick].reshape(16, groups, GROUP).transpose(1, 0, 2).copy()
    unit = (rows / np.maximum(np.linalg.norm(rows, axis=1), 1e-12)[:, None]).reshape(len(rows), groups, GROUP)
    cube = rows.reshape(len(rows), groups, GROUP)
    for _ in range(ROUNDS):
        codes = made.encode(rows, rounds=1)
        along = np.einsum("ngd,ngd->ng", cube - made.books[np.arange(groups), codes], unit)
        total = along.sum(axis=1)
        for g in range(groups):
            for k in range(16):
                own = codes[:, g] == k
                if not own.any():
                    made.books[g, k] = cube[rng.integers(len(cube)), g]
                    continue
                u, v = unit[own, g], cube[own, g]
                rest = (total - along[:, g])[own] + np.einsum("nd,nd->n", v, u)
                left = own.sum() * np.eye(GROUP) + (ALONG - 1) * u.T @ u
                made.books[g, k] = np.linalg.solve(left, v.sum(axis=0) + (ALONG - 1) * (rest[:, None] * u).sum(axis=0))
    if not np.isfinite(made.books).all():
        raise ValueError("a codebook isn't finite")
    return made


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances, squares summed in component order as an exact scan would; where those overflow, of scaled differences."""
    with np.errstate(over="ignore"):
        apart = x - q
        far = np.sqrt(np.add.accumulate(apart**2, axis=1)[:, -1])
        if (odd := np.flatnonzero(~np.isfinite(far))).size:
            half = x[odd] / 2 - q / 2
            top = np.abs(half).max(axis=1, keepdims=True)
            far[odd] = 2 * (top[:, 0] * np.sqrt(np.add.accumulate((half / top) ** 2, axis=1)[:, -1]))
    return far


def usable(vectors: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """vec_id, embedding of rows whose vector has `width` finite components and isn't zero."""
    ok = F.forall(F.col("embedding"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") == width) & ok & F.exists("embedding", lambda x: x != 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """The index: vec_id, embedding and two codes a byte for every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = books.encode(books.rows(_matrix(batch.column(1), books.width)))
            if codes.shape[1] % 2:
                codes = np.pad(codes, ((0, 0), (0, 1)))
            packed = codes[:, ::2] | (codes[:, 1::2] << 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in packed], pa.binary())], names=["vec_id", "embedding", "codes"])

    return rows.mapInArrow(of, "vec_id long, embedding array<double>, codes binary")


def _first(approx: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the `most` largest, ties to smaller ids; ids are sorted."""
    if len(approx) <= most:
        return np.arange(len(approx))
    edge = np.partition(approx, len(approx) - most)[len(approx) - most]
    over = np.flatnonzero(approx > edge)
    return np.r_[over, np.flatnonzero(approx == edge)[: most - len(over)]]


def search_block(index: DataFrame, books: Codebooks, ids: np.ndarray, queries: np.ndarray, k: int, rerank: int) -> DataFrame:
    """query_id, vec_id, score: each batch's best for one block of queries, by the exact distance."""
    tables = np.einsum("qgd,gcd->qgc", books.queries(queries).reshape(len(queries), books.groups, GROUP), books.books).astype(np.float32)
    shared = index.sparkSession.sparkContext.broadcast((ids, queries, tables))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, luts = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0).to_numpy()
            order = np.argsort(own, kind="stable")
            own, x = own[order], _matrix(batch.column(1), books.width)[order]
            packed = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(own), -1)[order]
            codes = np.empty((packed.shape[1] * 2, len(own)), np.intp)
            codes[::2], codes[1::2] = (packed & 15).T, (packed >> 4).T
            out = ([], [], [])
            wide = np.flatnonzero(books.wide(x))
            exact = books.wide(q)
            for i, query_id in enumerate(q_ids.tolist()):
                approx = luts[i, 0].take(codes[0])
                for g in range(1, books.groups):
                    approx += luts[i, g].take(codes[g])
                best = np.arange(len(own)) if exact[i] else _first(approx, own, max(k * rerank, int(len(own) * RERANKED)))
                if len(wide):
                    best = np.union1d(best, wide)
                best = best[own[best] != query_id]
                far = distances(x[best], q[i])
                best, far = (a[np.lexsort((own[best], far))[:k]] for a in (best, far))
                out[0].append(np.full(len(best), query_id))
                out[1].append(own[best])
                out[2].append(far)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(of, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k nearest found.

    Components more than 2**20 times the sample's median don't fit the codes: such rows
    are reranked by all queries, and such queries scan all rows. Distances beyond double
    precision are infinite.
    Null, zero or partly null or non-finite vectors, those with another number of
    components than most have, and rows without an id take no part. Equal distances
    rank by smaller id, repeated vectors included. Rows that repeat an id are
    candidates each; a query meets no row of its own id. No usable row gives no rows;
    further columns are not read.
    """
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    widths = vectors.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], schema)
    width = widths[0]["w"]
    rows = usable(vectors, id_col, vector_col, width)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect()
    if not sample:
        return spark.createDataFrame([], schema)
    books = train(np.array([r[0] for r in sample]))
    index = saved(coded(rows, books), "ann-index")
    asked = index.where(F.col("vec_id") % every == 0)
    blocks = -(-asked.count() // QUERY_BLOCK)
    found = None
    for b in range(blocks):  # one pass over the index for each block of queries
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "embedding").orderBy("vec_id").collect()
        if part:
            near = search_block(index, books, np.array([r[0] for r in part]), np.array([r[1] for r in part]), k, rerank)
            found = near if found is None else found.unionByName(near)
    if found is None:
        return spark.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
