"""SimHash near-deduplication with the generalised pigeonhole principle.

The 64 bits are split into parts of correlated bits. If two fingerprints differ in
at most T bits and the parts' thresholds add up to T - parts + 1, some part differs
in no more bits than its threshold. The thresholds are unequal: dynamic programming
picks those with the least estimated probes and candidates. A threshold is met by
flipping half of its bits on either side, so that candidates share a key.

Candidates of one key are checked against the least fingerprint under it. Keys whose
members are then still apart are compared further, in blocks, but only between
components. No pairs of a group are listed, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bitset import bitset, in_bitset
from .common import discard, saved, slices, table
from .components import components

BITS = 64
#: Members of one block of a key that stays unresolved.
BLOCK = 512


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    """SimHash of the shingles of `words` words; zero without words. Unsigned."""
    return fingerprints_of(text, words, (seed,))[0]


def fingerprints_of(text: str | None, words: int, seeds: tuple[int, ...]) -> list[int]:
    """A text's fingerprints by several seeds of the shingles' hash."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    n = len(found) - words + 1
    if not found:
        return [0] * len(seeds)
    whole = b" ".join(found)
    if n <= 1:
        return [xxhash.xxh64_intdigest(whole, seed) for seed in seeds]
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts, out, digest = [0, *(ends[:-1] + 1).tolist()], [], xxhash.xxh64_digest
    rows = [whole[a:b] for a, b in zip(starts, ends[words - 1:].tolist(), strict=False)]
    for seed in seeds:
        raw = np.frombuffer(b"".join([digest(r, seed) for r in rows]), np.uint8).reshape(n, BITS // 8)
        ones = np.zeros(BITS, np.int64)
        for at in range(0, n, 4096):
            ones += np.unpackbits(raw[at:at + 4096], axis=1).sum(axis=0, dtype=np.int32)
        out.append(int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big"))
    return out


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) for every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return rows.mapInArrow(of, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, in how many both are set; over all rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy(zero_copy_only=False))
            both += bits.T @ bits
            n += len(bits)
        i, j = np.meshgrid(np.arange(BITS), np.arange(BITS), indexing="ij")
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(both.ravel().astype(np.int64)),
             pa.array(np.full(BITS * BITS, n), pa.int64())], names=["i", "j", "both", "n"])

    sums = fps.select("fp").mapInArrow(of, "i int, j int, both long, n long").groupBy("i", "j").agg(
        F.sum("both").alias("both"), F.sum("n").alias("n")).collect()  # 64 x 64 rows
    both, n = np.zeros((BITS, BITS)), 0
    for i, j, b, n in sums:
        both[i, j] = b
    return n, both


def _bits(fp: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each fingerprint; column b holds the bit of weight 2**b."""
    return np.unpackbits(fp.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size; correlated bits come together."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        want = BITS // parts + (k < BITS % parts)
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left -= {*group}
        while len(group) < want:
            group.append(max(sorted(left), key=lambda b: corr[b, group].sum()))
            left -= {group[-1]}
        groups.append(sorted(group))
    return groups


def _choose(n: int, r: int) -> int:
    return sum(len(list(combinations(range(n), k))) for k in range(r + 1))


def thresholds(n: int, both: np.ndarray, groups: list[list[int]], most: int) -> list[int]:
    """One threshold a part (-1: not probed) with the least estimated probes and candidates.

    A part's candidates follow from how often its bits disagree between two
    fingerprints, by all rows' bit counts: the number of disagreeing bits is a sum
    of independent ones, convolved bit by bit.
    """
    share = np.diag(both) / max(n, 1)
    costs = []
    for group in groups:
        chance = np.array([1.0])
        for b in group:
            p = 2 * share[b] * (1 - share[b])
            chance = np.convolve(chance, [1 - p, p])
        cost = {-1: 0.0}
        for t in range(min(most, 4) + 1):
            flips = _choose(len(group), (t + 1) // 2) + (_choose(len(group), t // 2) if t % 2 else 0)
            cost[t] = n * flips + n * n / 2 * chance[: t + 1].sum()
        costs.append(cost)
    need = most - len(groups) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:  # best: by the sum of thresholds so far
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t, c in cost.items():
                if total + t not in step or spent + c < step[total + t][0]:
                    step[total + t] = (spent + c, [*chosen, t])
        best = step
    return best[need][1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def part_flips(groups: list[list[int]], chosen: list[int]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Number, mask and flips of each probed part; `near` marks the flips within the smaller half of its threshold."""
    plans = []
    for part, (group, t) in enumerate(zip(groups, chosen, strict=True)):
        if t >= 0:
            flips = [(_signed(sum(1 << b for b in c)), r <= t // 2) for r in range((t + 1) // 2 + 1) for c in combinations(group, r)]
            plans.append((part, _signed(sum(1 << b for b in group)), np.array([f for f, _ in flips], np.int64), np.array([n for _, n in flips])))
    return plans


def probes(fps: DataFrame, groups: list[list[int]], chosen: list[int], wanted: np.ndarray | None = None) -> DataFrame:
    """part, key, fp, near: `near` marks the keys within the smaller half of the part's threshold.

    With `wanted`, a filter over keys, only keys that it lets through.
    """
    plans = part_flips(groups, chosen)
    shared = None if wanted is None else fps.sparkSession.sparkContext.broadcast(wanted)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy()
            for at in range(0, len(every), 2048):
                fp = every[at:at + 2048]
                for part, mask, flips, near in plans:
                    key = ((fp & mask)[:, None] ^ flips).ravel()
                    cols = key, np.repeat(fp, len(flips)), np.tile(near, len(fp))
                    if shared is not None:
                        kept = in_bitset(shared.value, key ^ part)
                        cols = tuple(c[kept] for c in cols)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(cols[0]), part, np.int32)), *map(pa.array, cols)], names=["part", "key", "fp", "near"])

    return fps.select("fp").mapInArrow(of, "part int, key long, fp long, near boolean")


def _close(a, b, most: int):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most


def spanning(fp: list[int], component: list[int], near: list[bool], most: int) -> list[tuple[int, int]]:
    """Links between members of different components, as many as join them."""
    fp, component, found = np.array(fp, np.int64), np.array(component, np.int64), []
    for i in np.flatnonzero(near).tolist():
        close = (component != component[i]) & (np.bitwise_count((fp ^ fp[i]).view(np.uint64)) <= most)
        while close.any():
            j = int(close.argmax())
            found.append((int(fp[i]), int(fp[j])))
            component[component == component[j]] = component[i]
            close &= component != component[i]
    return found


def _within_blocks(members: DataFrame, most: int) -> DataFrame:
    """Links a, b between different components of the same key, in blocks of bounded size."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp", "part"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    rows = members.withColumn("own", own)
    near = rows.where("near").select("part", "key", "fp", "component", F.col("own").alias("right"), every.alias("left"), F.lit(True).alias("near"))
    far = rows.select("part", "key", "fp", "component", F.col("own").alias("left"), every.alias("right"), F.lit(False).alias("near"))

    def of(group: pa.Table) -> pa.Table:
        found = spanning(*(group.column(c).to_pylist() for c in ("fp", "component", "near")), most)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return near.unionByName(far).groupBy("part", "key", "left", "right").applyInArrow(of, "a long, b long")


def linked(fps: DataFrame, most: int = 4, parts: int = 2) -> DataFrame:
    """fp, component for every fingerprint that has a link; `fps` holds each fingerprint once."""
    n, both = bit_statistics(fps)
    if n == 0:
        return fps.select("fp", F.col("fp").alias("component"))
    groups = correlated_parts(n, both, parts)
    chosen = thresholds(n, both, groups, most)
    # Fingerprints are small and their keys many, so they are dealt out before they multiply; a table in that many files keeps them dealt.
    n_parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = saved(fps.select("fp"), "simhash-distinct")
    dealt = held.repartition(n_parts, F.xxhash64("fp"))
    keys = probes(dealt, groups, chosen).groupBy("part", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("near"), F.col("fp"))).alias("least")).where("n > 1 and least is not null")
    keys = saved(keys, "simhash-keys")
    wanted = bitset(keys.select(F.col("key").bitwiseXOR(F.col("part").cast("long")).alias("key")), "key")
    rows = probes(dealt, groups, chosen, wanted)
    members = saved(rows.hint("merge").join(keys.hint("merge"), ["part", "key"]), "simhash-members")
    discard(keys)
    star = members.where(_close("fp", "least", most)).select(F.col("fp").alias("a"), F.col("least").alias("b"))
    first = saved(components(star).select(F.col("node").alias("fp"), "component"), "simhash-components")
    named = members.where("n > 2").join(first, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    apart = named.groupBy("part", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    more = saved(_within_blocks(named.join(apart.select("part", "key"), ["part", "key"], "left_semi"), most), "simhash-more")
    if more.isEmpty():
        return first
    tree = first.select(F.col("fp").alias("a"), F.col("component").alias("b")).unionByName(more)
    return components(tree).select(F.col("node").alias("fp"), "component")


def simhash_groups(docs: DataFrame, words: int = 5, most: int = 4, parts: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the least doc_id of the component) for every row.

    Texts without words, null ones among them, have fingerprint zero and are linked
    like any other; shorter texts than a shingle are one shingle. Rows with the same
    id each have a row; a component all of whose ids are null has a null id. An
    empty table gives no rows; further columns are not read.
    """
    own = saved(fingerprints(docs, words, id_col, text_col), "simhash")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    found = linked(distinct.select("fp"), most, parts)
    named = distinct.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_fp = named.join(ids, "component").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(by_fp, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), words=4, most=4)
