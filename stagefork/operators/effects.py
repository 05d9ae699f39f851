"""Effects of concepts on reranker scores: naive regression against a partialled-out one.

Nuisances are means of cells, cut by quartiles of the confounders, over the rows of the
other folds; so all is done in grouped sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import draw, jaccard, tokenize
from .interventions import word_vocabulary
from .worlds import Retrieval
from .quantiles import quantiles

CONCEPTS, BAND, FOLDS, REPS, SEED = 3, (0.05, 0.40), 5, 3, 42
CONFOUNDERS = ("doc_len", "doc_emb_norm", "lex_overlap", "query_len")
EXACT = "decimal(38,12)"


def concept_terms(r: Retrieval, n: int = CONCEPTS, lexicon: DataFrame | None = None) -> DataFrame:
    """term, df of the most common words in the band; `lexicon` (term) narrows them."""
    docs = r.n_docs
    df = word_vocabulary(r).select("term", "df").where(F.col("df").between(BAND[0] * docs, BAND[1] * docs))
    if lexicon is not None:
        df = df.join(lexicon, "term", "left_semi")
    return df.orderBy(F.desc("df"), "term").limit(n)


def dml_panel(r: Retrieval) -> DataFrame:
    """A row for each query, pool document and concept: score, confounders and whether the document has the concept."""
    def build():
        pooled = r.baseline.select("doc_id").distinct()
        norm = r.doc_vectors.select("doc_id", "norm").join(pooled, "doc_id", "left_semi")
        facts = r.docs.select("doc_id", "doc_len", "tokens", "content_tokens").join(pooled, "doc_id", "left_semi").join(norm, "doc_id", "left")
        own = tokenize(F.col("query_text"))
        rows = r.baseline.join(facts, "doc_id").join(F.broadcast(concept_terms(r).select(F.col("term").alias("concept"))))
        return rows.where("ce is not null").select(
            "query_id", "doc_id", "concept", F.array_contains("content_tokens", F.col("concept")).cast("int").alias("d"), F.col("ce").alias("ce_score"), "doc_len",
            F.round(F.coalesce("norm", F.lit(0.0)), 9).alias("doc_emb_norm"), F.round(jaccard(own, F.col("tokens")), 9).alias("lex_overlap"), F.size(own).cast("double").alias("query_len"), "bm25", "dense", "provenance")

    return r._table("panel", build)


def naive_ols(panel: DataFrame) -> DataFrame:
    """concept, n_units, n_treated, naive_coef, naive_se, ends: one binary regressor, errors clustered by query."""
    y, d = F.col("ce_score").cast(EXACT), F.col("d")
    whole = panel.groupBy("concept").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(d).cast("double").alias("n1"), F.sum(y).cast("double").alias("sy"), F.sum(y * d).cast("double").alias("sy1"), F.countDistinct("query_id").cast("double").alias("g"))
    whole = whole.where("n1 > 0 and n1 < n").withColumn("b", F.expr("sy1 / n1 - (sy - sy1) / (n - n1)")).withColumn("a", F.expr("(sy - sy1) / (n - n1)"))
    parts = panel.join(F.broadcast(whole), "concept").withColumn("u", F.expr("ce_score - a - b * d")).groupBy("concept", "query_id").agg(
        F.sum(F.col("u").cast(EXACT)).cast("double").alias("s0"), F.sum((F.col("u") * d).cast(EXACT)).cast("double").alias("s1"))
    meat = parts.groupBy("concept").agg(F.sum(F.expr("cast(s0 * s0 as decimal(38,12))")).cast("double").alias("m00"), F.sum(F.expr("cast(s0 * s1 as decimal(38,12))")).cast("double").alias("m01"), F.sum(F.expr("cast(s1 * s1 as decimal(38,12))")).cast("double").alias("m11"))
    # The bread's second row, times its determinant: (-n1, n).
    var = F.expr("(n1 * n1 * m00 - 2 * n1 * n * m01 + n * n * m11) / power(n * n1 - n1 * n1, 2) * g / (g - 1) * (n - 1) / (n - 2)")
    rows = whole.join(meat, "concept").withColumn("se", F.sqrt(var))
    return rows.select("concept", F.col("n").cast("long").alias("n_units"), F.col("n1").cast("long").alias("n_treated"), F.round("b", 6).alias("naive_coef"), F.round("se", 6).alias("naive_se"),
                       F.round(F.expr("b - 1.96 * se"), 6).alias("naive_ci_lo"), F.round(F.expr("b + 1.96 * se"), 6).alias("naive_ci_hi"))


def with_cells(panel: DataFrame) -> DataFrame:
    """A cell a row: for each confounder, how many of its quartiles lie below."""
    long = panel.select(*CONFOUNDERS).unpivot([], list(CONFOUNDERS), "name", "value")
    cuts = quantiles(long, ["name"], "value", (0.25, 0.5, 0.75)).agg(*(F.max(F.when(F.col("name") == c, F.col("q"))).alias(f"q_{c}") for c in CONFOUNDERS))
    rows = panel.join(F.broadcast(cuts))
    below = lambda c: F.size(F.filter(f"q_{c}", lambda q: q < F.col(c)))
    for c in CONFOUNDERS:
        rows = rows.withColumn(f"b_{c}", below(c))
    return rows.withColumn("cell", F.concat_ws("-", *(F.col(f"b_{c}").cast("string") for c in CONFOUNDERS))).select("query_id", "doc_id", "concept", "d", "ce_score", "cell")


def dml_plr(panel: DataFrame, folds: int = FOLDS, reps: int = REPS, by_query: bool = False, seed: int = SEED) -> DataFrame:
    """concept, dml_coef, dml_se, ends: partially linear, cross-fitted; the median over repetitions.

    Folds are drawn by row, or by query with `by_query`. A cell that the other folds
    lack takes their mean.
    """
    parts = [F.lit(seed), F.lit("fold"), F.col("rep"), F.col("query_id")] + ([] if by_query else [F.col("doc_id")])
    rows = with_cells(panel).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("fold", (draw(*parts) % folds).cast("int"))
    y, d = F.col("ce_score").cast(EXACT), F.col("d")
    sums = rows.groupBy("concept", "rep", "cell", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.sum(d).alias("d"))
    cell, all_, fold = Window.partitionBy("concept", "rep", "cell"), Window.partitionBy("concept", "rep"), Window.partitionBy("concept", "rep", "fold")
    for c in ("n", "y", "d"):
        sums = sums.withColumn(f"c_{c}", F.sum(c).over(cell) - F.col(c)).withColumn(f"a_{c}", F.sum(c).over(all_) - F.sum(c).over(fold))
    mean = lambda c: F.when(F.col("c_n") > 0, F.col(f"c_{c}").cast("double") / F.col("c_n")).otherwise(F.col(f"a_{c}").cast("double") / F.nullif(F.col("a_n"), F.lit(0)))
    fits = sums.select("concept", "rep", "cell", "fold", mean("y").alias("l"), mean("d").alias("m"))
    res = rows.join(fits, ["concept", "rep", "cell", "fold"]).select("concept", "rep", (F.col("ce_score") - F.col("l")).alias("u"), (d - F.col("m")).alias("v"))
    return estimates(res)


def estimates(res: DataFrame) -> DataFrame:
    """concept, dml_coef, dml_se, ends from residuals u of the score and v of the treatment: the median over repetitions."""
    theta = res.groupBy("concept", "rep").agg((F.sum((F.col("v") * F.col("u")).cast(EXACT)).cast("double") / F.nullif(F.sum((F.col("v") * F.col("v")).cast(EXACT)).cast("double"), F.lit(0.0))).alias("theta"))
    psi = F.col("v") * (F.col("u") - F.col("theta") * F.col("v"))
    errors = res.join(F.broadcast(theta), ["concept", "rep"]).groupBy("concept", "rep").agg(
        F.first("theta").alias("theta"), (F.sqrt(F.sum((psi * psi).cast(EXACT)).cast("double")) / F.sum((F.col("v") * F.col("v")).cast(EXACT)).cast("double")).alias("se"))
    out = errors.groupBy("concept").agg(F.percentile("theta", F.lit(0.5)).alias("b"), F.percentile("se", F.lit(0.5)).alias("se"))
    return out.select("concept", F.round("b", 6).alias("dml_coef"), F.round("se", 6).alias("dml_se"), F.round(F.expr("b - 1.96 * se"), 6).alias("dml_ci_lo"), F.round(F.expr("b + 1.96 * se"), 6).alias("dml_ci_hi"))


def dml_compare(naive: DataFrame, adjusted: DataFrame) -> DataFrame:
    both = naive.join(adjusted, "concept")
    outside = (F.col("naive_coef") < F.col("dml_ci_lo")) | (F.col("naive_coef") > F.col("dml_ci_hi"))
    return both.select("concept", "n_treated", "n_units", "naive_coef", "dml_coef", "dml_ci_lo", "dml_ci_hi", outside.alias("naive_outside_dml_ci"), F.round(F.abs(F.col("naive_coef") - F.col("dml_coef")), 6).alias("abs_shift"))
