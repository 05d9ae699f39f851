"""Exact top-k by inner product over whole-number vectors, in buckets of like length.

Vectors are sorted by length and packed into blocks whose longest and shortest differ
by a tenth at most. A query that already has k results with a least score asks of a
block only vectors whose cosine reaches that score over both lengths: the block's local
threshold. Above 1 the block is left out. A high threshold bounds every coordinate of a
candidate's direction, so the query's largest coordinates choose candidates from sorted
lists; with a low one only length prunes, and the block's prefix of long enough vectors
is multiplied as a matrix. Either way candidates' products are computed exactly.

Packs of queries meet every block through an equi-join on dealt numbers: nothing but a
block and a pack is in memory at once, and neither side goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import discard, saved, table

SCALE = 256
#: Vectors of a block and queries of a pack, and bytes of either at most; shortest against longest vector of a block.
BLOCK, PACK, BYTES, RATIO = 2048, 1024, 4 << 20, 0.9
#: Local threshold from which coordinates choose candidates; coordinates that a candidate must satisfy; slack for rounding.
COSINE, FOCUS, SLACK = 0.8, 5, 1e-9
#: Products of vectors in units of 1 / SCALE are exact in double precision below this product of lengths.
EXACT = float(1 << 36)
#: Ends of a long; lengths' product and score beyond which nothing is pruned; more than any score.
LOW, HIGH = -(1 << 63), (1 << 63) - 1
HUGE, WIDEST, BEYOND = 1e300, 1 << 1000, 10**700
#: Blocks of the longest vectors that give queries their first scores.
HEAD = 4
BLOCKS = "length double, shortest double, width int, ids binary, nulls binary, cells binary"
#: SQL of op11_top_products.
OP11_SQL = r"""
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x) / 256: exact, and finite for every finite x."""
    big = np.abs(x) >= 2.0**45
    return np.where(big, x, np.floor(np.where(big, 0.0, x) * SCALE) / SCALE)


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths that don't overflow before their own size does; rounded up a little."""
    top = np.abs(x).max(axis=1, initial=0.0)
    with np.errstate(over="ignore"):
        return top * np.linalg.norm(x / np.where(top > 0, top, 1.0)[:, None], axis=1) * (1 + SLACK)


def whole_number(x: float) -> int:
    """256 x of a cell of `whole`."""
    return int(x) * SCALE if abs(x) >= 2.0**45 else int(x * SCALE)


def vectors_of(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, embedding of vectors that aren't null and whose components are all finite."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & ok)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _packed(ids: np.ndarray, null: np.ndarray, x: np.ndarray, size: np.ndarray) -> dict:
    return {"length": float(size[0]), "shortest": float(size[-1]), "width": x.shape[1], "ids": ids.tobytes(), "nulls": np.packbits(null).tobytes(), "cells": np.ascontiguousarray(x).tobytes()}


def blocks_of(rows: DataFrame, most: int, ratio: float | None) -> DataFrame:
    """Rows (vec_id, embedding) as blocks of `most` vectors at most, longest first; `ratio` bounds shortest over longest."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n, cells = [], 0, 0

        def made() -> Iterator[pa.RecordBatch]:
            both = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            x, id_column = whole(_matrix(both.column(1))), both.column(0)
            size = lengths(x)
            order = np.argsort(-size, kind="stable")
            ids, null = id_column.fill_null(0).to_numpy()[order], id_column.is_null().to_numpy(zero_copy_only=False)[order]
            x, size, at, out = x[order], size[order], 0, []
            while at < len(x):
                to = len(x) if ratio is None else at + int(np.searchsorted(-size[at:], -size[at] * ratio, "right"))
                out.append(_packed(ids[at:to], null[at:to], x[at:to], size[at:to]))
                at = to
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("length", pa.float64()), ("shortest", pa.float64()), ("width", pa.int32()), ("ids", pa.binary()), ("nulls", pa.binary()), ("cells", pa.binary())]))

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                wide = max(1, int(np.diff(batch.column(1).offsets.to_numpy()).max(initial=1)))
                part = batch.slice(at, max(1, min(most - n, (BYTES - cells) // (8 * wide))))
                kept.append(part)
                n, cells, at = n + part.num_rows, cells + part.num_rows * 8 * wide, at + part.num_rows
                if n >= most or cells + 8 * wide > BYTES:
                    yield from made()
                    kept, n, cells = [], 0, 0
        if kept:
            yield from made()

    return rows.mapInArrow(of, BLOCKS)


class Block:
    """A block or pack in a task: ids (0 where null), which are null, and cells."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.null = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(self.ids)).astype(bool)
        self.x = np.frombuffer(row["cells"], np.float64).reshape(len(self.ids), row["width"])
        self.size = lengths(self.x)
        self.length = float(row["length"])
        self._lists = None

    @property
    def places(self) -> np.ndarray:
        """Place of each vector by id, null last and then as it stands: the order among equal scores."""
        out = np.empty(len(self.ids), np.int64)
        out[np.lexsort((self.ids, self.null))] = np.arange(len(self.ids))
        return out

    @property
    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Directions, and for each coordinate the vectors in its order with the sorted values."""
        if self._lists is None:
            unit = self.x / np.where(self.size > 0, self.size, 1.0)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            self._lists = unit, order, np.take_along_axis(unit, order, axis=0)
        return self._lists


def by_coordinates(block: Block, direction: np.ndarray, cosine: float, focus: int = FOCUS) -> np.ndarray:
    """Places in the block that may have this cosine with a unit `direction`: its largest coordinates bound theirs."""
    unit, order, values = block.lists
    width = min(len(direction), unit.shape[1])
    chosen = np.argsort(-np.abs(direction[:width]), kind="stable")[:focus]
    d = direction[chosen]
    spread = np.sqrt(max(0.0, 1 - cosine * cosine) * np.maximum(0.0, 1 - d * d))
    # Beyond the cosine t the angle is below arccos t, so a coordinate stays within these, or reaches the pole where d is beyond t.
    low = np.where(-d >= cosine, -1.0, d * cosine - spread) - 1e-6
    high = np.where(d >= cosine, 1.0, d * cosine + spread) + 1e-6
    ends = [(int(np.searchsorted(values[:, c], lo, "left")), int(np.searchsorted(values[:, c], hi, "right"))) for c, lo, hi in zip(chosen, low, high, strict=True)]
    best = min(range(len(ends)), key=lambda i: ends[i][1] - ends[i][0])
    places = order[ends[best][0] : ends[best][1], chosen[best]]
    for i, c in enumerate(chosen):
        if i != best and len(places):
            own = unit[places, c]
            places = places[(own >= low[i]) & (own <= high[i])]
    return np.sort(places)


def products(x: np.ndarray, y: np.ndarray, exact: bool) -> np.ndarray:
    """256^2 times the products of rows: longs where `exact` lengths allow double precision, else Python's whole numbers."""
    width = min(x.shape[1], y.shape[1])
    if exact:
        return np.rint((x[:, :width] @ y[:, :width].T) * (SCALE * SCALE)).astype(np.int64)
    a, b = ([[whole_number(v) for v in row] for row in m[:, :width].tolist()] for m in (x, y))
    out = np.empty((len(a), len(b)), object)
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            out[i, j] = sum(u * v for u, v in zip(p, q, strict=True))
    return out


class Best:
    """The k best of each query of a pack so far: score, then id with null last."""

    def __init__(self, pack: Block, k: int, least: np.ndarray | None):
        self.pack, self.k = pack, k
        self.found: list[list[tuple]] = [[] for _ in pack.ids]
        self.least = [None] * len(pack.ids) if least is None else list(least)

    def floor(self, i: int):
        """Score that a candidate must reach, or None."""
        return self.found[i][-1][0] if len(self.found[i]) == self.k and (self.least[i] is None or self.found[i][-1][0] >= self.least[i]) else self.least[i]

    def add(self, i: int, scores: np.ndarray, block: Block, places: np.ndarray) -> None:
        """Take those of a block's `places` that are among the best; `scores` goes with them."""
        floor = self.floor(i)
        stay = (block.ids[places] != self.pack.ids[i]) | block.null[places]
        if floor is not None:
            stay &= np.asarray(scores >= floor, bool)
        scores, places = scores[stay], places[stay]
        if not len(scores):
            return
        if scores.dtype != object and len(scores) > 4 * self.k:
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            level = np.flatnonzero(scores == edge)
            level = level[np.argsort(block.places[places[level]], kind="stable")[: self.k]]
            pick = np.concatenate([np.flatnonzero(scores > edge), level])
            scores, places = scores[pick], places[pick]
        new = [(s, bool(n), v) for s, n, v in zip(scores.tolist(), block.null[places].tolist(), block.ids[places].tolist(), strict=True)]
        self.found[i] = sorted(self.found[i] + new, key=lambda f: (-f[0], f[1], f[2]))[: self.k]


def search(pack: Block, block: Block, best: Best) -> None:
    """Let a pack's queries take what a block has for them."""
    exact = float(pack.size.max(initial=0)) * block.length < EXACT
    every = np.arange(len(block.ids))
    by_length: dict[int, list[int]] = {}
    for i, size in enumerate(pack.size.tolist()):
        floor, reach = best.floor(i), size * block.length
        if floor is None or floor <= 0 or reach > HUGE or floor > WIDEST:
            by_length.setdefault(len(every), []).append(i)
            continue
        local = floor / (SCALE * SCALE) / reach * (1 - 4 * SLACK) if reach else 2.0
        if local > 1:
            continue
        if local >= COSINE:
            places = by_coordinates(block, pack.x[i] / size, local)
            if len(places):
                best.add(i, products(pack.x[i : i + 1], block.x[places], exact)[0], block, places)
            continue
        long_enough = int(np.searchsorted(-block.size, -(local * block.length), "right"))
        # Prefixes are rounded up to quarters of the block, so that queries share a product.
        step = max(1, len(every) // 4)
        by_length.setdefault(min(len(every), -(-long_enough // step) * step), []).append(i)
    for to, queries in by_length.items():
        for i, scores in zip(queries, products(pack.x[queries], block.x[:to], exact) if to else (), strict=False):
            floor = best.floor(i)
            if floor is None or scores.max() >= floor:
                best.add(i, scores, block, every[:to])


def _results(pack: int, best: Best) -> pa.RecordBatch:
    rows = [(pack, i, q, min(max(s, LOW), HIGH), None if LOW <= s <= HIGH else str(BEYOND + s), None if null else v)
            for i, (q, own) in enumerate(zip(best.pack.ids.tolist(), best.found, strict=True)) for s, null, v in own]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["pack", "place", "query_id", "score", "beyond", "vec_id"])


def scanned(packs: DataFrame, blocks: DataFrame, k: int, parts: int) -> DataFrame:
    """pack, place, query_id, score, beyond, vec_id: the k best of each of `parts` parts of the blocks, for every query.

    Blocks are dealt to parts by a hash and packs are copied to each, so that a part's
    packs meet its blocks by an equi-join. `beyond` orders scores outside a long's range.
    """
    dealt = blocks.select(F.pmod(F.xxhash64("ids", "cells"), F.lit(parts)).cast("int").alias("part"), F.struct(*blocks.columns).alias("b"))
    copies = packs.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "pack", F.struct("length", "width", "ids", "nulls", "cells").alias("q"), "least")
    met = copies.hint("merge").join(dealt.hint("merge"), "part").select("pack", "q", "least", "b")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                # A pack's blocks come one after another; where they don't, its results leave in several parts.
                if (pack := batch.column(0)[r].as_py()) != now or best is None:
                    if best is not None:
                        yield _results(now, best)
                    now, best = pack, Best(Block(batch.column(1)[r].as_py()), k, batch.column(2)[r].as_py())
                search(best.pack, Block(batch.column(3)[r].as_py()), best)
        if best is not None:
            yield _results(now, best)

    return met.mapInArrow(of, "pack long, place int, query_id long, score long, beyond string, vec_id long")


def top_products(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k rows with the largest products of floor(256 x).

    Null vectors and those holding null or non-finite components take no part; zero and
    empty ones do. Vectors of different lengths meet as if the shorter one ended in
    zeros. Equal scores rank by smaller id, a null id last. Rows that repeat an id are
    candidates each, but a query meets no row of its own id; a row that repeats id and
    vector asks once, one with another vector asks for itself. Products beyond 64 bits
    are compared exactly and returned as the nearest long. No usable row, or no query,
    gives no rows; other columns aren't read.
    """
    spark = vectors.sparkSession
    rows = vectors_of(vectors, id_col, vector_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    ranged = rows.withColumn("size", size).repartitionByRange(parts, F.desc("size"), F.xxhash64("vec_id", "embedding")).sortWithinPartitions(F.desc("size"))
    blocks = saved(blocks_of(ranged.select("vec_id", "embedding"), BLOCK, RATIO), "product-blocks")
    asked = saved(rows.where(F.col("vec_id") % every == 0).distinct(), "product-queries")
    least = F.lit(None).cast("array<long>").alias("least")
    packs = saved(blocks_of(asked.repartition(max(1, -(-asked.count() // PACK))), PACK, None).select(F.monotonically_increasing_id().alias("pack"), "*"), "product-packs")
    # The longest vectors give every query a score to reach, before all are searched.
    head = blocks.orderBy(F.desc("length"), F.xxhash64("ids")).limit(HEAD)
    first = scanned(packs.select("*", least), head, k, 1)
    reached = first.groupBy("pack", "place").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.count("beyond").alias("beyond")).where((F.col("n") >= k) & (F.col("beyond") == 0))
    known = reached.groupBy("pack").agg(F.map_from_entries(F.collect_list(F.struct("place", "least"))).alias("known"))
    places = F.sequence(F.lit(0), (F.octet_length("ids") / 8 - 1).cast("int"))
    with_least = saved(packs.join(known, "pack", "left").select(*packs.columns, F.transform(places, lambda i: F.col("known")[i]).alias("least")), "product-packs")
    dealt = max(1, min(4 * parts, blocks.count() // 4))
    best = Window.partitionBy("pack", "place").orderBy(F.desc("score"), F.desc("beyond"), F.asc_nulls_last("vec_id"))
    found = scanned(with_least, blocks, k, dealt).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = saved(found.select("query_id", "rank", "vec_id", "score"), "products")
    for made in (blocks, asked, packs, with_least):
        discard(made)
    return out


def op11_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))
