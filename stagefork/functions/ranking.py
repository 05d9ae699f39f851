"""Rank overlap and gains as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rbo(a: Column, b: Column, p: float = 0.9) -> Column:
    """Extrapolated rank-biased overlap of two lists without repeats; uneven lengths are allowed.

    Both empty: 1; one empty: 0.
    """
    s, l = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    short = F.when(F.size(a) <= F.size(b), a).otherwise(b)
    long_ = F.when(F.size(a) <= F.size(b), b).otherwise(a)

    def overlap(d: Column) -> Column:
        return F.size(F.array_intersect(F.slice(short, 1, F.least(d, s)), F.slice(long_, 1, d))).cast("double")

    def step(total: Column, d: Column) -> Column:
        tail = F.when(d > s, overlap(s) * (d - s) / (s * d)).otherwise(0.0)
        return total + (overlap(d) / d + tail) * F.pow(F.lit(p), d)

    sums = F.aggregate(F.sequence(F.lit(1), l), F.lit(0.0), step)
    end = ((overlap(l) - overlap(s)) / l + overlap(s) / s) * F.pow(F.lit(p), l)
    return F.when((s == 0) & (l == 0), 1.0).when(s == 0, 0.0).otherwise(sums * (1 - p) / p + end)


def gain(relevance: Column, rank: Column) -> Column:
    """Discounted gain of a graded relevance at a rank from 1."""
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank + 1.0)
