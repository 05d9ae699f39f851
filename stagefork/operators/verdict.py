"""The verdict over a run: three criteria, each a predicate over small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MOST_SHARE, LEAST_SHIFT = 90.0, 10.0


def criteria(contrast: DataFrame, ratio: DataFrame, shift: DataFrame, effects: DataFrame) -> DataFrame:
    """criterion, status: PASS, FAIL or INCONCLUSIVE where its tables are empty."""
    status = lambda ok, has: F.when(~F.coalesce(has, F.lit(False)), "INCONCLUSIVE").when(ok, "PASS").otherwise("FAIL")
    one = contrast.agg(F.max("lo").alias("lo"), F.max("n_clusters").alias("n"))
    c1 = one.select(F.lit("C1").alias("criterion"), status(F.col("lo") > 0, F.col("n") > 0).alias("status"))
    shares = [c for c in ratio.columns if c.endswith("_share_pct")]
    top = ratio.agg(F.max(F.greatest(*shares)).alias("top"), F.count(F.lit(1)).alias("n")).join(shift.agg(F.max("shift_pp").alias("moved")))
    c2 = top.select(F.lit("C2").alias("criterion"), status((F.col("top") <= MOST_SHARE) & (F.col("moved") >= LEAST_SHIFT), F.col("n") >= 2).alias("status"))
    c3 = effects.agg(F.count_if("naive_outside_dml_ci").alias("k"), F.count(F.lit(1)).alias("n")).select(F.lit("C3").alias("criterion"), status(F.col("k") > 0, F.col("n") > 0).alias("status"))
    return c1.unionByName(c2).unionByName(c3)


def verdict(found: DataFrame) -> DataFrame:
    """n_pass, n_inconclusive, verdict: yes with three passes, no with one at most and nothing open, else mixed."""
    n = found.agg(F.count_if(F.col("status") == "PASS").alias("n_pass"), F.count_if(F.col("status") == "INCONCLUSIVE").alias("n_inconclusive"))
    says = F.when(F.col("n_pass") == 3, "yes").when((F.col("n_pass") <= 1) & (F.col("n_inconclusive") == 0), "no").otherwise("mixed")
    return n.select("n_pass", "n_inconclusive", says.alias("verdict"))


SAYS = {"PASS": "holds", "FAIL": "does not hold", "INCONCLUSIVE": "can't be judged: its tables are missing or empty"}
CLAIMS = {
    "C1": "the interval of the difference between treatment and control lies above zero",
    "C2": "no path carries nearly all of the effect, and shares move between contrasts",
    "C3": "a naive estimate lies outside the orthogonalised interval",
}


def verdict_text(found: DataFrame) -> str:
    """Markdown of `criteria` (three rows) and the verdict over them."""
    by = {r["criterion"]: r["status"] for r in found.collect()}
    over = verdict(found).first()
    lines = [f"- **{name}** ({by[name]}): that {CLAIMS[name]} {SAYS[by[name]]}." for name in sorted(by)]
    note = f" {over['n_inconclusive']} open." if over["n_inconclusive"] else ""
    return "\n".join([*lines, "", f"Verdict: **{over['verdict']}**, {over['n_pass']} of {len(by)} criteria pass.{note}"])


def failed_checks(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, n_failed for a registry of predicates over the columns of `rows`, in one pass; a predicate that is null fails."""
    if not checks:
        return rows.sparkSession.createDataFrame([], "check string, n_failed long")
    counts = rows.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()))
    return counts.unpivot([], list(checks), "check", "n_failed")


def log_checks(k: int = 20) -> dict[str, Column]:
    """Predicates that each row of an intervention log meets, by name; ranks behind `k` are censored."""
    rank = lambda c: F.col(c).between(1, k + 1)
    return {
        "ranks_in_range": rank("base_rank") & rank("new_rank"),
        "delta_is_a_difference": F.col("delta_rank") == F.col("base_rank") - F.col("new_rank"),
        "controls_leave_bm25_alone": (F.col("arm") != "control") | (F.col("delta_bm25") == 0),
        "term_is_injected": F.contains(F.col("injected_query"), F.col("term")),
        "select_prob_is_a_chance": F.col("select_prob").isNull() | F.col("select_prob").between(0, 1),
    }


def baseline_check(summary: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """channel, ndcg, lo, hi, expected: the mean gains of `ndcg_summary` against the ranges that a full run is known for."""
    wide = summary.select(*ranges).unpivot([], list(ranges), "channel", "ndcg")
    known = F.create_map(*(x for name, (lo, hi) in ranges.items() for x in (F.lit(name), F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi")))))
    rows = wide.withColumn("r", known[F.col("channel")]).select("channel", "ndcg", "r.lo", "r.hi")
    return rows.withColumn("expected", F.coalesce(F.col("ndcg").between(F.col("lo"), F.col("hi")), F.lit(False)))
