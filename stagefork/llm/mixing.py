"""Mixing sources to target weights with fixed-length blocks.

Every source's documents are laid end to end and cut into blocks of equal token
counts. The mix is a row of output shards with a fixed number of slots; a shard
draws from a multinomial how many slots each source fills. A source's slots are
numbered through; slot number j takes the block that a pseudorandom permutation
of the source's block indices has at j, a new permutation for every pass. Blocks
and slots are joined by index.

Draws deviate from their mean, so the numbers are then settled: slots beyond a
source's target are filled by sources that fell short, and a source has the slots
of its target exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import SPACE_CLASS, free_name, saved, slices, table

#: Words of a block, slots of an output shard, documents of a piece that one task lays end to end.
BLOCK, SLOTS, PIECE = 64, 4096, 4096
WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES = 3


@dataclass(frozen=True)
class Share:
    """A source's part of the mix."""

    place: int
    source: str | None
    size: int
    target: float
    blocks: int
    slots: int


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE_CLASS}]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST_PASSES) -> list[float]:
    """Shares of the summed sizes by weight; none above `most` times its size.

    What lies above is shared again by weight among the others until none is above.
    """
    found, held, total = [0.0] * len(sizes), set(), float(sum(sizes))
    while len(held) < len(sizes):
        left = total - sum(most * sizes[i] for i in held)
        weight = sum(w for i, w in enumerate(weights) if i not in held)
        for i, w in enumerate(weights):
            found[i] = float(most * sizes[i]) if i in held else left * w / weight
        above = {i for i in range(len(sizes)) if i not in held and found[i] > most * sizes[i]}
        if not above:
            break
        held |= above
    else:
        found = [float(most * s) for s in sizes]
    return found


def shares(sized: DataFrame, weights=WEIGHTS, block: int = BLOCK, most: float = MOST_PASSES) -> list[Share]:
    """The sources by code point, null last; a row for each source comes to the driver."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [int(r["size"]) for r in rows]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], most)
    out = []
    for i, (r, size, aim) in enumerate(zip(rows, sizes, aims, strict=True)):
        blocks = -(-size // block)
        out.append(Share(i, r.source, size, aim, blocks, round(aim / size * blocks) if size else 0))
    return out


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of 0..n-1 under a keyed permutation: a Feistel network, walked until it is below n."""
    half = np.uint64(max(1, -(-(max(n - 1, 1)).bit_length() // 2)))
    low = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "big")) for r in range(4)]

    def once(v):
        left, right = v >> half, v & low
        for k in keys:
            m = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            m = (m ^ (m >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((m ^ (m >> np.uint64(32))) & low)
        return (left << half) | right

    out = once(x.astype(np.uint64))
    while (beyond := out >= np.uint64(n)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def _key(seed: int, source: str | None, epoch: int) -> int:
    named = f"{seed}|{epoch}|{'-' if source is None else '+' + source}"
    return int.from_bytes(hashlib.blake2b(named.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")


def slots(spark: SparkSession, parts: list[Share], seed: int, per_shard: int = SLOTS) -> DataFrame:
    """shard, place, pass, block for every slot of the mix."""
    total = sum(p.slots for p in parts)
    schema = "shard long, place int, pass int, block long"
    if not total:
        return spark.createDataFrame([], schema)
    chances = [p.slots / total for p in parts]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for shard in batch.column(0).to_pylist():
                n = min(per_shard, total - shard * per_shard)
                counts = np.random.default_rng([seed, shard]).multinomial(n, chances)
                rows += [(shard, i, int(c)) for i, c in enumerate(counts) if c]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["shard", "place", "n"])

    drawn = spark.range(-(-total // per_shard)).mapInArrow(draw, "shard long, place int, n long")
    before = Window.partitionBy("place").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = saved(drawn.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "mix-draws")
    got = dict(drawn.groupBy("place").agg(F.sum("n")).collect())  # a row for each source
    short = [max(0, p.slots - got.get(p.place, 0)) for p in parts]
    wanted = F.element_at(F.array(*[F.lit(p.slots).cast("long") for p in parts]), F.col("place") + 1)
    drawn = drawn.withColumn("used", F.greatest(F.lit(0), F.least("n", wanted - F.col("first")))).withColumn("spare", F.col("n") - F.col("used"))
    # Only the last shards of a source have spare slots, so few rows meet in this window.
    order = Window.orderBy("shard", "place").rowsBetween(Window.unboundedPreceding, -1)
    spare = drawn.where("spare > 0").select("shard", F.col("spare").alias("n"), F.coalesce(F.sum("spare").over(order), F.lit(0)).alias("first"), F.lit(-1).alias("place"))
    rows = drawn.where("used > 0").select("shard", F.col("used").alias("n"), "first", "place").unionByName(spare)
    ends = np.cumsum(short)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, n, first, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number = np.arange(first, first + n)
                which = np.full(n, at) if at >= 0 else np.searchsorted(ends, number, side="right")
                for i in np.unique(which).tolist():
                    p, own = parts[i], number[which == i]
                    if at < 0:  # behind the slots that the source drew itself
                        own = own - (ends[i] - short[i]) + got.get(i, 0)
                    turn, index = own // p.blocks, own % p.blocks
                    block = np.empty(len(own), np.int64)
                    for e in np.unique(turn).tolist():
                        block[turn == e] = permuted(index[turn == e], p.blocks, _key(seed, p.source, e))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), shard)), pa.array(np.full(len(own), i), pa.int32()), pa.array(turn.astype(np.int32)), pa.array(block)],
                        names=["shard", "place", "pass", "block"])

    # Few rows become many slots, so they are dealt out by shard first.
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("shard", "n", "first", "place").repartition(n_parts, F.xxhash64("shard", "place")).mapInArrow(place, schema)


def block_spans(sized: DataFrame, parts: list[Share], block: int = BLOCK) -> DataFrame:
    """key, place, block, start, end: which words of a document lie in which block of its source.

    Two steps give each document its offset: within pieces of some thousand documents,
    and over the pieces' sums, so that no source is laid out in one task.
    """
    spark = sized.sparkSession
    place = spark.createDataFrame([(p.source, p.place) for p in parts], "source string, place int")
    rows = sized.join(F.broadcast(place), sized["source"].eqNullSafe(place["source"])).drop("source")
    pieces = rows.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    rows = rows.join(F.broadcast(pieces), "place").withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")))
    sums = rows.groupBy("place", "piece").agg(F.sum("size").alias("n"))
    behind = Window.partitionBy("place").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("place", "piece", F.coalesce(F.sum("n").over(behind), F.lit(0)).alias("base"))
    within = Window.partitionBy("place", "piece").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.where("size > 0").withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["place", "piece"])
    laid = laid.select("key", "place", "size", (F.col("at") + F.col("base")).alias("at"))
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    cut = laid.withColumn("block", F.explode(F.sequence(first, last)))
    return cut.select(
        "key", "place", "block",
        F.greatest(F.lit(0), F.col("block") * block - F.col("at")).alias("start"),
        F.least("size", (F.col("block") + 1) * block - F.col("at")).alias("end"))


def sized_rows(docs: DataFrame, source_col: str = "source", text_col: str = "text", key=None) -> DataFrame:
    """key, source, size; `key` orders a source's documents and should tell rows apart."""
    return docs.select(key.alias("key"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))


def mix_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS,
               most: float = MOST_PASSES, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row.

    Null sources are one source, placed last; a null or empty text has no words, is
    never taken and still has its row. Rows with the same id and the same text are
    told apart by a running number and laid out one after the other. An empty table
    gives no rows; further columns are not read.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    rows = sized_rows(docs, source_col, text_col, key)
    number = Window.partitionBy("key", "source").orderBy("size")
    rows = saved(rows.withColumn("key", F.struct("key.id", "key.h", F.row_number().over(number).alias("copy"))), "mix-sizes")
    parts = shares(rows, weights, block, most)
    spark = docs.sparkSession
    uses = slots(spark, parts, seed).groupBy("place", "block").agg(F.count(F.lit(1)).alias("uses"))
    spans = block_spans(rows, parts, block)
    # Slots come from few draws, so Spark would take them for a small table and broadcast it.
    taken = spans.hint("merge").join(uses.hint("merge"), ["place", "block"]).groupBy("place", "key").agg(F.sum((F.col("end") - F.col("start")) * F.col("uses")).alias("taken"))
    share = spark.createDataFrame([(p.source, p.place, p.size, p.target) for p in parts], "own_source string, place int, source_size long, target double")
    found = rows.join(F.broadcast(share), rows["source"].eqNullSafe(share["own_source"])).join(taken, ["place", "key"], "left")
    return found.select(F.col("key.id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS,
                  most: float = MOST_PASSES, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The mix as rows of `docs`: one for each pass that takes words of a document.

    A row's text holds the words that the pass takes, with the white space between
    and around them; a document that is taken whole is left as it is. All other columns
    are the document's own. A null, empty or blank text has no words and is never taken;
    a null source is one source, placed last; repeated rows, null and equal ids are
    documents of their own. An empty table gives no rows.
    """
    spark, names = docs.sparkSession, docs.columns
    key, words = free_name(docs, "_mix_key"), free_name(docs, "_mix_spans")
    keyed = saved(docs.withColumn(key, F.monotonically_increasing_id()), "mix-documents")
    rows = sized_rows(keyed, source_col, text_col, F.col(key))
    parts = shares(rows, weights, block, most)
    spans = block_spans(rows, parts, block).hint("merge").join(slots(spark, parts, seed).hint("merge"), ["place", "block"])
    drawn = spans.groupBy("key", "pass").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    drawn = drawn.select(F.col("key").alias(key), F.col("spans").alias(words))
    word = f"[{SPACE_CLASS}]*[^{SPACE_CLASS}]+"

    found = keyed.join(drawn, key)
    found = found.withColumn(text_col, F.col(text_col).cast("string")).select(*names, words)
    place = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            out = []
            for t, spans in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                runs: list[list[int]] = []
                for s in spans:
                    if runs and runs[-1][1] == s["start"]:
                        runs[-1][1] = s["end"]
                    else:
                        runs.append([s["start"], s["end"]])
                ends = [0, *(m.end() for m in re.finditer(word, t))]
                ends[-1] = len(t)
                out.append("".join(t[ends[a]:ends[b]] for a, b in runs))
            columns = [pa.array(out, pa.string()) if k == place else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(cut, found.select(*names).schema)


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents"))
