"""How far sources of one language are from each other, by their terms' shares.

A term's share in a group of documents is a whole number of billionths, smoothed by
one. The divergence of two groups sums a whole-number term over the vocabulary, nearly
all of which occurs in neither; so a pair starts at the vocabulary's size times the
value of two zero counts, and only terms that occur in one or both correct it:

* a group's terms are summed once for each of its counts, against a partner's zero;
* terms that both have are met through an inverted index, whose postings emit what the
  two sums above got wrong.

All arithmetic is exact: counts as long, shares and squares as decimals where they may
leave 64 bits.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import discard, saved, slices, table

SCALE = 1_000_000_000
LEAST_DOCS, TERM_RANKS = 3, 200
#: Bytes that belong to no term: ASCII but for letters. UTF-8 of other characters has no such bytes.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Entries that a task counts before it hands them on; pairs of postings that it works on at a time.
ENTRIES, PAIRS = 1 << 19, 1 << 20
WIDE = "decimal(38,0)"
#: SQL of op12_divergence, by plain sums over the whole vocabulary.
OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (
  SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS own FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT t.lang, t.source, t.term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(own)::HUGEINT AS whole FROM kept GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce(v.whole, 0) AS whole,
             coalesce((SELECT sum(n)::HUGEINT FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0) AS size FROM g LEFT JOIN v ON g.lang = v.lang),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.size + s.v) AS p,
         1 + (1000000000::HUGEINT * (k.own + 1)) // (s.whole + s.v) AS q
  FROM s JOIN kept k ON s.lang = k.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::HUGEINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM both_parts)
WHERE part = 'pair' OR rank <= 200
"""


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters and of characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_LOWER).split()


def term_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n, own, lead of terms in `least_docs` documents of their language: occurrences in the group and in the language.

    Counts are summed within each task before they are dealt out by language and term;
    group and language are then both summed without another shuffle. `lead` marks one
    row of each term of a language.
    """
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        held = 0
        for part in slices(batches, 2):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.binary()).to_pylist(), strict=True):
                n, own = seen[lang, source]
                once = Counter(terms_of(text))
                held -= len(n)
                n.update(once)
                own.update(once.keys())
                held += len(n)
            if held > ENTRIES:
                yield from _counted(seen)
                seen.clear()
                held = 0
        yield from _counted(seen)

    rows = given.mapInArrow(of, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    counts = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    counts = counts.select("*", F.sum("n").over(whole).alias("own"), F.sum("docs").over(whole).alias("all"), (F.col("source") == F.min("source").over(whole)).alias("lead"))
    return counts.where(F.col("all") >= least_docs).drop("docs", "all")


def _counted(seen) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]
    for (lang, source), (n, own) in seen.items():
        terms = pa.array(list(n), pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), terms, pa.array(list(n.values()), pa.int64()), pa.array([own[t] for t in n], pa.int64())], names=names)


def share(count: Column, size: Column, vocabulary: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (size + vocabulary)), as a long."""
    up = (F.lit(SCALE).cast(WIDE) * (count + 1).cast("decimal(19,0)")).cast(WIDE)
    whole = F.call_function("div", up, (size + vocabulary).cast("decimal(19,0)"))
    return (whole + 1).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are 10^9 + 1 at most, so the square stays within a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def _floor_gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def joint_corrections(index: DataFrame) -> DataFrame:
    """lang, source, item, value for pairs of sources with common terms: what the two one-sided sums get wrong.

    A posting list has an entry for each source at most, which carries its share p and
    the share p0 of a zero count. Pairs are worked on by the million, and summed for
    each pair of sources before they leave.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            langs = batch.column(0).dictionary_encode()
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            source, p, p0 = flat.field("source").dictionary_encode(), flat.field("p").to_numpy(), flat.field("p0").to_numpy()
            names, codes = source.dictionary.to_pylist(), source.indices.to_numpy().astype(np.int64)
            begin = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
            lang_names, lang_code = langs.dictionary.to_pylist(), langs.indices.to_numpy().astype(np.int64)
            found: dict[int, int] = defaultdict(int)
            # An entry meets all entries of its list; entries are cut to runs with about PAIRS pairs.
            partners = np.repeat(sizes, sizes).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            ends, at = np.cumsum(partners), 0
            while at < len(partners):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                many = partners[at:to]
                a = np.repeat(np.arange(at, to), many)
                b = np.repeat(begin[owner[at:to]] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(len(a))
                apart = a != b
                a, b = a[apart], b[apart]
                value = _floor_gap(p[a], p[b]) - _floor_gap(p[a], p0[b]) - _floor_gap(p0[a], p[b]) + _floor_gap(p0[a], p0[b])
                key = (lang_code[owner[a]] * len(names) + codes[a]) * len(names) + codes[b]
                keys, place = np.unique(key, return_inverse=True)
                # Halves of 32 bits are summed apart: a sum of a million values may leave 64 bits.
                low, high = np.bincount(place, value & 0xFFFFFFFF, len(keys)), np.bincount(place, value >> 32, len(keys))
                for k, lo, hi in zip(keys.tolist(), low.tolist(), high.tolist(), strict=True):
                    found[k] += int(lo) + (int(hi) << 32)
                at = to
            if found:
                n, ks = len(names), list(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang_names[k // (n * n)] for k in ks]), pa.array([names[k // n % n] for k in ks]), pa.array([names[k % n] for k in ks]), pa.array([str(found[k]) for k in ks])],
                    names=["lang", "source", "item", "value"])

    rows = index.select("lang", "postings").mapInArrow(of, "lang string, source string, item string, value string")
    return rows.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast(WIDE)).alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its divergence from each other source of its language, and its own most telling terms.

    Nulls in text, lang and source count as empty text; rows that repeat an id are
    documents of their own (ids aren't read); groups without terms still have pairs, of
    value 0 where their language keeps no term; a language with one source has no pairs.
    Equal values rank by item in UTF-8. No rows give none; other columns aren't read.
    The result has a row for every ordered pair of sources of a language.
    """
    inside = saved(term_counts(docs, least_docs), "divergence-terms", "zstd")
    langs = inside.where("lead").groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("own").alias("whole"))
    sizes = inside.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    zero = F.lit(0).cast("long")
    groups = named.join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("v", zero).alias("v"), F.coalesce("whole", zero).alias("whole"), F.coalesce("size", zero).alias("size"))
    groups = groups.withColumn("p0", F.when(F.col("v") > 0, share(zero, F.col("size"), F.col("v"))))
    groups = saved(groups, "divergence-groups")
    postings = inside.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("size"), F.col("v")))

    # Against a partner's zero: one row for each count that a group has.
    repeats = inside.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("times")).join(groups, ["lang", "source"])
    repeats = repeats.select("lang", "source", "p0", share(F.col("n"), F.col("size"), F.col("v")).alias("p"), "times")
    zeros = groups.where("v > 0").select("lang", "p0").distinct()
    have = lambda mine, others: F.sum((mine - others).cast(WIDE) * F.col("times"))
    met = repeats.withColumnRenamed("p0", "own0").join(zeros.withColumnRenamed("p0", "other0"), "lang")
    sided = met.groupBy("lang", "source", "other0").agg(
        have(gap(F.col("p"), F.col("other0")), gap(F.col("own0"), F.col("other0"))).alias("as_group"),
        have(gap(F.col("other0"), F.col("p")), gap(F.col("other0"), F.col("own0"))).alias("as_item"))
    sided = saved(sided, "divergence-sides")

    a = groups.select("lang", "source", "v", F.col("p0").alias("a0"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0"))
    both = a.join(b, "lang").where("source <> item")
    mine = sided.select("lang", "source", F.col("other0").alias("b0"), "as_group")
    theirs = sided.select("lang", F.col("source").alias("item"), F.col("other0").alias("a0"), "as_item")
    index = postings.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("postings"))
    none = F.lit(0).cast(WIDE)
    start = F.when(F.col("v") > 0, gap(F.col("a0"), F.col("b0")).cast(WIDE) * F.col("v"))
    pairs = both.join(mine, ["lang", "source", "b0"], "left").join(theirs, ["lang", "item", "a0"], "left").join(
        joint_corrections(index).withColumnRenamed("value", "joint"), ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item",
                         (F.coalesce(start, none) + F.coalesce("as_group", none) + F.coalesce("as_item", none) + F.coalesce("joint", none)).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    q = share(F.col("own"), F.col("whole"), F.col("v"))
    telling = postings.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    telling = telling.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    out = saved(pairs.unionByName(telling), "divergence")
    for made in (inside, groups, sided):
        discard(made)
    return out


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))
