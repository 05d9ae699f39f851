"""Path effects by freezing stages: which text a stage sees decides which path is open."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .worlds import Retrieval
from .interventions import injected
from .retrieval import K

#: Which text each stage sees in each world: the query's own (0) or the injected one (1), for BM25, dense, reranker.
WORLDS = {
    "baseline": (0, 0, 0), "full": (1, 1, 1), "freeze_candidates": (0, 0, 1),
    "freeze_rerank": (1, 1, 0), "freeze_dense": (1, 0, 1), "freeze_bm25": (0, 1, 1),
}
PATHS = ("reranker", "lexical", "dense", "residual")


def world_table(pairs: DataFrame, first_stages=("union", "bm25")) -> DataFrame:
    """query_id, doc_id, term, cfg, world and the world's texts; `pairs` has query_text and injected_query."""
    worlds = F.array(*(F.struct(F.lit(name).alias("world"), *(F.lit(x).alias(s) for x, s in zip(seen, ("b", "d", "r"), strict=True))) for name, seen in WORLDS.items()))
    rows = pairs.select("query_id", "doc_id", "term", "query_text", "injected_query", F.explode(F.array(*map(F.lit, first_stages))).alias("cfg"))
    rows = rows.select("*", F.explode(worlds).alias("w"))
    text = lambda s: F.when(F.col(f"w.{s}") == 1, F.col("injected_query")).otherwise(F.col("query_text"))
    rows = rows.select("query_id", "doc_id", "term", "cfg", F.col("w.world").alias("world"), text("b").alias("bm25_text"), text("d").alias("dense_text"), text("r").alias("rerank_text"))
    key = F.concat_ws("\t", "cfg", "bm25_text", F.when(F.col("cfg") == "bm25", "").otherwise(F.col("dense_text")), "rerank_text")
    return rows.withColumn("world_id", key)


def mediation_paths(r: Retrieval, pairs: DataFrame | None = None) -> DataFrame:
    """Ranks of a pair's target in all worlds and the effects along each path; treatment pairs by default."""
    def build():
        rows = world_table(pairs if pairs is not None else injected(r).where("arm = 'treatment'"))
        worlds = rows.groupBy("world_id").agg(F.first("cfg").alias("first_stage"), *(F.min(f"{s}_text").alias(f"{s}_text") for s in ("bm25", "dense", "rerank")))
        ranks = r.run(worlds).select("world_id", "doc_id", "rank")
        rank = F.coalesce("rank", F.lit(K + 1))
        wide = rows.join(ranks, ["world_id", "doc_id"], "left").groupBy("query_id", "doc_id", "term", "cfg").agg(
            *(F.max(F.when(F.col("world") == name, rank)).alias(f"r_{name}") for name in WORLDS))
        wide = wide.withColumn("total", F.expr("r_baseline - r_full")).withColumn("reranker", F.expr("r_baseline - r_freeze_candidates"))
        wide = wide.withColumn("lexical", F.expr("r_freeze_candidates - r_freeze_dense")).withColumn("dense", F.expr("case when cfg = 'bm25' then 0 else r_freeze_candidates - r_freeze_bm25 end"))
        return wide.withColumn("residual", F.expr("total - reranker - lexical - dense")).withColumn("first_stage_total", F.expr("r_baseline - r_freeze_rerank"))

    return build() if pairs is not None else r._table("mediation", build)


def mediation_ratio(paths: DataFrame) -> DataFrame:
    """cfg, n_pairs and for each path its mean, mean size and share of the summed mean sizes."""
    mean = lambda c: F.avg(c.cast("double"))
    rows = paths.groupBy("cfg").agg(F.count(F.lit(1)).alias("n_pairs"), mean(F.abs("total")).alias("mean_abs_total"), mean(F.col("total")).alias("mean_total"),
                                    *(mean(F.abs(p)).alias(f"{p}_mean_abs") for p in PATHS), *(mean(F.col(p)).alias(f"{p}_mean") for p in PATHS))
    whole = sum((F.col(f"{p}_mean_abs") for p in PATHS[1:]), F.col(f"{PATHS[0]}_mean_abs"))
    rows = rows.withColumn("whole", whole)
    for p in PATHS:
        rows = rows.withColumn(f"{p}_share_pct", F.when(F.col("whole") > 0, 100 * F.col(f"{p}_mean_abs") / F.col("whole")).otherwise(0.0))
    rows = rows.withColumn("nonadditivity_pct_of_total", F.when(F.col("mean_abs_total") > 0, 100 * F.col("residual_mean_abs") / F.col("mean_abs_total")).otherwise(0.0)).drop("whole")
    return rows.select("cfg", "n_pairs", *(F.round(c, 9).alias(c) for c in rows.columns if c not in ("cfg", "n_pairs")))


def mediation_shift(ratio: DataFrame) -> DataFrame:
    """path, shift_pp: how far a path's share moves between the two configurations."""
    long = ratio.select("cfg", F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.col(f"{p}_share_pct").alias("share")) for p in PATHS))).alias("x")).select("cfg", "x.path", "x.share")
    wide = long.groupBy("path").agg(*(F.max(F.when(F.col("cfg") == c, F.col("share"))).alias(c) for c in ("union", "bm25")))
    return wide.select("path", F.round(F.abs(F.col("union") - F.col("bm25")), 6).alias("shift_pp"))
