"""Learned nuisances on planted data, and that no model scores a row that it has seen."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagefork.operators import effects as E, learned as L

EFFECT = 2.0


def panel(spark, n, seed, treated=None):
    """A binary treatment that hangs on the confounders, as the score does, not linearly."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [3, 1, 0.2, 2] + [50, 8, 0.5, 5]
    z = (x - [50, 8, 0.5, 5]) / [3, 1, 0.2, 2]
    chance = 1 / (1 + np.exp(-(1.2 * z[:, 0] + 0.6 * z[:, 1] * z[:, 2])))
    d = (rng.random(n) < chance).astype(int) if treated is None else np.full(n, treated)
    y = EFFECT * d + 3 * z[:, 0] + z[:, 1] ** 2 + z[:, 1] * z[:, 2] + rng.normal(size=n)
    rows = [(int(i % 97), int(i), "c", int(d[i]), float(y[i]), *map(float, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "query_id long, doc_id long, concept string, d int, ce_score double, doc_len double, doc_emb_norm double, lex_overlap double, query_len double")


@pytest.mark.parametrize("by_query", [False, True])
def test_ridge_finds_the_planted_effect(spark, by_query):
    rows = panel(spark, 4000, 1)
    naive, row = E.naive_ols(rows).first(), L.dml_plr_learned(rows, reps=2, by_query=by_query).first()
    assert row.dml_ci_lo <= EFFECT <= row.dml_ci_hi and row.learner_m == "logistic"
    assert row.dml_coef == pytest.approx(EFFECT, abs=0.15) and 0.02 < row.dml_se < 0.08 and row.dml_pval < 0.001
    assert not naive.naive_ci_lo <= EFFECT <= naive.naive_ci_hi
    assert row.dml_pval == pytest.approx(math.erfc(abs(row.dml_coef / row.dml_se) / math.sqrt(2)), abs=1e-6)


def test_forests_find_it_roughly(spark):
    rows = panel(spark, 3000, 2)
    naive, row = E.naive_ols(rows).first(), L.dml_plr_learned(rows, L.forest_nuisances(10, 6), folds=2, reps=1).first()
    assert abs(row.dml_coef - EFFECT) < abs(naive.naive_coef - EFFECT) / 3 and row.learner_m == "forest classifier"


def test_each_fold_is_scored_by_the_others(spark):
    """A learner that remembers the rows it was trained on meets none of them again; queries stay whole."""
    rows = panel(spark, 300, 3)
    folded = L.folded(rows, 5, 2, True, 42)
    assert folded.groupBy("rep", "query_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert folded.groupBy("rep").agg(F.countDistinct("fold").alias("n")).where("n < 5").count() == 0
    # The prediction of a row doesn't change with its own score and treatment.
    pick = F.col("doc_id") == 7
    other = rows.withColumn("ce_score", F.when(pick, 1e6).otherwise(F.col("ce_score"))).withColumn("d", F.when(pick, 1 - F.col("d")).otherwise(F.col("d")))
    own = [L.ridge_nuisances(L.folded(t, 5, 1, False, 42), 5).where(pick).select("l", "m").first() for t in (rows, other)]
    assert tuple(own[0]) == pytest.approx(tuple(own[1]), abs=1e-9)


def test_ridge_by_plain_solving(spark):
    rows = panel(spark, 200, 4)
    got = {r["doc_id"]: r for r in L.ridge_nuisances(L.folded(rows, 2, 1, False, 42), 2).collect()}
    z = {i: L.design(np.array([r["x"]]))[0] for i, r in got.items()}
    for f in (0, 1):
        train = [i for i, r in got.items() if r["fold"] != f]
        a, b = np.array([z[i] for i in train]), np.array([got[i]["y"] for i in train])
        pen = L.PENALTY * len(train) * np.diag([0.0] + [1.0] * (a.shape[1] - 1)) + 1e-9 * np.eye(a.shape[1])
        beta = np.linalg.solve(a.T @ a + pen, a.T @ b)
        assert all(r["l"] == pytest.approx(z[i] @ beta, abs=1e-6) for i, r in got.items() if r["fold"] == f)


def test_concepts_that_all_or_none_have(spark):
    for treated in (0, 1):
        assert L.dml_plr_learned(panel(spark, 60, 5, treated), folds=2, reps=1).count() == 0
    assert L.dml_plr_learned(panel(spark, 60, 5).limit(0), folds=2, reps=1).count() == 0


def test_treatment_that_the_confounders_decide_falls_back(spark):
    rows = panel(spark, 200, 6).withColumn("d", (F.col("doc_len") > 50).cast("int"))
    found = L.ridge_nuisances(L.folded(rows, 2, 1, False, 42), 2).select("m", "learner_m").collect()
    assert all(math.isfinite(r["m"]) for r in found)
