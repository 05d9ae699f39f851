"""Means by arm and cluster bootstrap intervals over the intervention log.

A cluster's rows are first reduced to sums and counts; a replicate then draws clusters
with replacement, by hashes, and takes the ratio of sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import draw
from ..sources.store import numbered

#: Replicates of an interval; clusters of a block, which one row holds.
REPLICATES, BLOCK = 1000, 4096


def arm_means(log: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.avg(c.cast("decimal(38,12)")).cast("double"), 9)
    return log.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), mean(F.col("delta_rank")).alias("mean_delta_rank"), mean(F.abs("delta_rank")).alias("mean_abs_delta_rank"),
        mean(F.col("delta_ce")).alias("mean_delta_ce"), mean(F.col("delta_bm25")).alias("mean_delta_bm25"), mean(F.col("delta_dense")).alias("mean_delta_dense"))


def cluster_sums(log: DataFrame, value: str = "abs(delta_rank)") -> DataFrame:
    """query_id, arm, s, n over rows that have a value."""
    return log.select("query_id", "arm", F.expr(value).cast("double").alias("v")).where("v is not null").groupBy("query_id", "arm").agg(F.sum("v").alias("s"), F.count("v").alias("n"))


def replicates(clusters: DataFrame, n: int, seed: int, sums: list[str], block: int = BLOCK) -> DataFrame:
    """rep and the drawn clusters' summed columns; `clusters` has query_id and those columns, a row a cluster.

    Clusters lie in blocks, each an array. A replicate's draws are first counted by block,
    of which only the counts are shuffled, and then made within the block: the same
    multinomial counts, without a row for each draw to join back.
    """
    size = clusters.count()
    reps = clusters.sparkSession.range(n).select(F.col("id").alias("rep"))
    own = F.struct(*(F.col(c).cast("double").alias(c) for c in sums))
    if size <= block:
        packs = clusters.agg(F.array_sort(F.collect_list(F.struct(F.col("query_id").alias("at"), own.alias("v")))).alias("own"))
        drawn, key = reps.select("rep", F.lit(size).alias("k")).join(F.broadcast(packs)), [F.col("rep")]
    else:
        packs = numbered(clusters, "query_id", to="at").groupBy(F.expr(f"at div {block}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", own.alias("v")))).alias("own"))
        every = clusters.sparkSession.range(n * size).select(F.expr(f"id div {size}").alias("rep"), (F.col("id") % size).alias("i"))
        dealt = every.withColumn("x", draw(seed, "block", F.col("rep"), F.col("i")) % size).select("rep", F.expr(f"x div {block}").alias("block"))
        drawn, key = dealt.groupBy("rep", "block").agg(F.count(F.lit(1)).alias("k")).join(packs, "block"), [F.col("rep"), F.col("block")]
    place = lambda j: (draw(seed, "boot", *key, j) % F.size("own")).cast("int")
    zero = F.struct(*(F.lit(0.0).alias(c) for c in sums))
    added = lambda s, j: F.struct(*((s[c] + F.col("own")[place(j)]["v"][c]).alias(c) for c in sums))
    parts = drawn.where("k > 0").select("rep", F.aggregate(F.sequence(F.lit(0), (F.col("k") - 1).cast("int")), zero, added).alias("v"))
    return parts.groupBy("rep").agg(*(F.sum(F.col("v")[c]).alias(c) for c in sums))


def _interval(means: DataFrame, point: DataFrame, names: list[str]) -> DataFrame:
    ends = means.groupBy(*names).agg(F.round(F.percentile("m", F.lit(0.025)), 9).alias("lo"), F.round(F.percentile("m", F.lit(0.975)), 9).alias("hi"))
    return point.join(ends, names) if names else point.join(ends)


def bootstrap_ci(log: DataFrame, value: str = "abs(delta_rank)", n: int = REPLICATES, seed: int = 42) -> DataFrame:
    """arm, point, lo, hi of the mean over rows; clusters are queries."""
    sums = cluster_sums(log, value)
    out = None
    for arm in ("control", "treatment"):
        own = sums.where(F.col("arm") == arm).select("query_id", "s", "n")
        means = replicates(own, n, seed, ["s", "n"]).select((F.col("s") / F.col("n")).alias("m"))
        found = _interval(means, own.agg(F.round(F.sum("s") / F.sum("n"), 9).alias("point")), []).select(F.lit(arm).alias("arm"), "point", "lo", "hi")
        out = found if out is None else out.unionByName(found)
    return out


def arm_pairs(log: DataFrame, value: str = "abs(delta_rank)") -> DataFrame:
    """query_id, s_t, n_t, s_c, n_c for clusters that have both arms."""
    wide = cluster_sums(log, value).groupBy("query_id").agg(
        *(F.sum(F.when(F.col("arm") == arm, F.col(c))).alias(f"{c}_{arm[0]}") for arm in ("treatment", "control") for c in ("s", "n")))
    return wide.where("n_t > 0 and n_c > 0")


def bootstrap_diff_ci(log: DataFrame, value: str = "abs(delta_rank)", n: int = REPLICATES, seed: int = 43) -> DataFrame:
    """point, lo, hi, n_clusters of the treatment's mean less the control's; both arms of a cluster are drawn together."""
    own = arm_pairs(log, value)
    gap = F.col("s_t") / F.col("n_t") - F.col("s_c") / F.col("n_c")
    means = replicates(own, n, seed, ["s_t", "n_t", "s_c", "n_c"]).select(gap.alias("m"))
    point = own.agg(*(F.sum(c).alias(c) for c in ("s_t", "n_t", "s_c", "n_c")), F.count(F.lit(1)).alias("n_clusters")).select(F.round(gap, 9).alias("point"), "n_clusters")
    return _interval(means, point, []).select("point", "lo", "hi", "n_clusters")


def contrast_uncensored(log: DataFrame) -> DataFrame:
    """Mean absolute rank change by arm over rows whose target ranked before; only when both arms are left."""
    left = log.where("not base_censored")
    arms = left.agg(F.countDistinct("arm").alias("arms"))
    return left.join(F.broadcast(arms)).where("arms = 2").groupBy("arm").agg(F.round(F.avg(F.abs("delta_rank")), 9).alias("mean_abs_delta_rank"), F.count(F.lit(1)).alias("n"))


def delta_rank_hist(log: DataFrame) -> DataFrame:
    return log.groupBy("arm", "delta_rank").agg(F.count(F.lit(1)).alias("n"))


def any_statistic(log: DataFrame, statistic, value: str = "delta_rank") -> DataFrame:
    """query_id, arm, stat by a function of a pandas Series: the way for statistics that sums don't give."""
    def of(rows):
        return rows.groupby(["query_id", "arm"], as_index=False)["v"].agg(stat=statistic)

    rows = log.select("query_id", "arm", F.expr(value).cast("double").alias("v")).where("v is not null")
    return rows.groupBy("query_id", "arm").applyInPandas(of, "query_id long, arm string, stat double")
