"""Exact quantiles whose shuffles carry counts by value, with no group's values in one task.

A mergeable sketch cuts each group's values into some hundred buckets; their counts say
in which bucket a rank lies, and only that bucket's distinct values are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BUCKETS = 256


def quantiles(rows: DataFrame, by: list[str], value: str, shares: tuple[float, ...], buckets: int = BUCKETS) -> DataFrame:
    """`by` and q: an array with the value at each of `shares`, between neighbours in proportion.

    Nulls are left out; a group of nulls alone has no row. Equal values count each.
    """
    own = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    counts = own.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    cuts = own.groupBy(*by).agg(F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 4 * buckets).alias("_cuts"), F.count(F.lit(1)).alias("_total"))
    placed = _joined(counts, cuts, by).select(*by, "_v", "_n", F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col("_v"))).alias("_bucket"))
    filled = placed.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_m"))
    filled = filled.withColumn("_before", F.sum("_m").over(Window.partitionBy(*by).orderBy("_bucket")) - F.col("_m"))
    at = F.col("_p") * (F.col("_total") - 1)
    asked = cuts.select(*by, "_total", F.posexplode(F.array(*map(F.lit, map(float, shares)))).alias("_i", "_p")).select(*by, "_i", at.alias("_at"), F.floor(at).alias("_lo"), F.ceil(at).alias("_hi"))
    inside = lambda r: (F.col(r) >= F.col("_before")) & (F.col(r) < F.col("_before") + F.col("_m"))
    hit = _joined(filled, asked, by).where(inside("_lo") | inside("_hi")).select(*by, "_bucket", "_before").distinct()
    near = placed.join(F.broadcast(hit), [*by, "_bucket"])  # a few buckets a group and share
    end = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_bucket").orderBy("_v"))
    near = near.select(*by, "_v", (end - F.col("_n")).alias("_from"), end.alias("_to"))
    value_at = lambda r: F.max(F.when((F.col(r) >= F.col("_from")) & (F.col(r) < F.col("_to")), F.col("_v")))
    found = _joined(near, asked, by).groupBy(*by, "_i", "_at", "_lo", "_hi").agg(value_at("_lo").alias("_a"), value_at("_hi").alias("_b"))
    q = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.col("_hi") - F.col("_at")) * F.col("_a") + (F.col("_at") - F.col("_lo")) * F.col("_b"))
    return found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", q.alias("q")))), lambda x: x["q"]).alias("q"))


def _joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    return left.join(right, by) if by else left.crossJoin(right)
