"""Partially linear effects with learned nuisances: cross-fitted, so that no model scores a row that it has seen.

Two learners come with it. Ridge regression with squares and products of the confounders
takes one pass of sums for all concepts, repetitions and folds at once, and its logistic
form for the treatment a pass for each Newton step; what comes to the driver are matrices
of a fixed size, one a model. Forests are fitted fold by fold by Spark's MLlib.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import draw
from ..sources.store import scratch
from .effects import CONFOUNDERS, FOLDS, REPS, SEED, estimates

#: Weight of the penalty for each row; Newton steps, and the size of the last at which they have converged.
PENALTY, STEPS, CONVERGED = 1e-3, 12, 1e-6
KEYS = ("concept", "rep", "fold")
#: (rows with concept, rep, fold, d, y and x; number of folds) to those rows with l, m and learner_m.
Nuisances = Callable[[DataFrame, int], DataFrame]


def design(x: np.ndarray) -> np.ndarray:
    """One, each column, squares and products."""
    a, b = np.triu_indices(x.shape[1])
    return np.hstack([np.ones((len(x), 1)), x, x[:, a] * x[:, b]])


def _columns(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    rep, fold, d, y = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("rep", "fold", "d", "y"))
    return batch.column("concept"), rep.astype(int), fold.astype(int), d, y, x


def _groups(concept: pa.Array, rep: np.ndarray) -> Iterator[tuple[str, int, np.ndarray]]:
    coded = concept.dictionary_encode()
    codes = coded.indices.to_numpy()
    for c, name in enumerate(coded.dictionary.to_pylist()):
        for r in np.unique(rep[codes == c]):
            yield name, int(r), np.flatnonzero((codes == c) & (rep == r))


def _summed(rows: DataFrame, own: Callable[[str, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[int, np.ndarray]]) -> dict[tuple, np.ndarray]:
    """Sums by concept, repetition and fold of what `own` gives for the rows of a batch; one array a model comes back."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                concept, rep, fold, d, y, x = _columns(batch)
                for name, r, at in _groups(concept, rep):
                    for f, v in own(name, r, fold[at], d[at], y[at], design(x[at])).items():
                        held[name, r, f] = held.get((name, r, f), 0) + v
        if held:
            keys = list(zip(*held, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.string()), pa.array(keys[1], pa.int32()), pa.array(keys[2], pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=[*KEYS, "v"])

    parts = rows.select("concept", "rep", "fold", "d", "y", "x").mapInArrow(of, "concept string, rep int, fold int, v array<double>")
    long = parts.select(*KEYS, F.posexplode("v").alias("i", "v")).groupBy(*KEYS, "i").agg(F.sum("v").alias("v"))
    found = long.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("v")).collect()
    return {(r["concept"], r["rep"], r["fold"]): np.array(r["v"]) for r in found}


def _solved(a: np.ndarray, b: np.ndarray, n: float) -> np.ndarray:
    return np.linalg.solve(a + PENALTY * max(n, 1.0) * np.diag([0.0] + [1.0] * (len(a) - 1)) + 1e-9 * np.eye(len(a)), b)


def ridge_nuisances(rows: DataFrame, folds: int) -> DataFrame:
    """l by ridge regression, m by ridge logistic regression; where that doesn't converge, m by ridge regression."""
    def moments(name, r, fold, d, y, z):
        return {int(f): np.concatenate([(z[own].T @ z[own]).ravel(), z[own].T @ y[own], z[own].T @ d[own]]) for f in np.unique(fold) for own in [fold == f]}

    by_fold = _summed(rows, moments)
    linear_l, linear_m, logit, size = {}, {}, {}, {}
    for name, r in {k[:2] for k in by_fold}:
        for f in range(folds):
            v = sum((x for k, x in by_fold.items() if k[:2] == (name, r) and k[2] != f), np.zeros(len(next(iter(by_fold.values())))))
            p = int(round(math.sqrt(len(v) + 1))) - 1
            a, key = v[: p * p].reshape(p, p), (name, r, f)
            size[key] = a[0, 0]
            linear_l[key], linear_m[key] = _solved(a, v[p * p:p * p + p], a[0, 0]), _solved(a, v[p * p + p:], a[0, 0])
            if 0 < v[p * p + p] < a[0, 0]:
                logit[key] = np.zeros(p)
    moved = dict.fromkeys(logit, math.inf)
    for _ in range(STEPS):
        if not (open_ := {k for k, step in moved.items() if step > CONVERGED}):
            break

        def newton(name, r, fold, d, y, z, now=dict(logit), open_=frozenset(open_)):
            out = {}
            for f in range(folds):
                if (name, r, f) in open_:
                    own = fold != f
                    p = 1 / (1 + np.exp(-np.clip(z[own] @ now[name, r, f], -30, 30)))
                    out[f] = np.concatenate([((z[own] * (p * (1 - p))[:, None]).T @ z[own]).ravel(), z[own].T @ (d[own] - p)])
            return out

        for key, v in _summed(rows, newton).items():
            p, beta = len(logit[key]), logit[key]
            ridge = PENALTY * size[key] * np.r_[0.0, np.ones(p - 1)]
            step = np.linalg.solve(v[: p * p].reshape(p, p) + np.diag(ridge) + 1e-9 * np.eye(p), v[p * p:] - ridge * beta)
            logit[key], moved[key] = beta + step, float(np.abs(step).max()) if np.isfinite(step).all() else math.inf
    fine = {k for k, step in moved.items() if step <= CONVERGED}
    schema = T.StructType([*rows.schema, *T.StructType.fromDDL("l double, m double, learner_m string")])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            concept, rep, fold, d, y, x = _columns(batch)
            l, m, how = np.zeros(len(d)), np.zeros(len(d)), np.empty(len(d), object)  # noqa: E741
            for name, r, at in _groups(concept, rep) if len(d) else ():
                z = design(x[at])
                for f in np.unique(fold[at]):
                    own, key = fold[at] == f, (name, r, int(f))
                    l[at[own]] = z[own] @ linear_l[key]
                    m[at[own]] = 1 / (1 + np.exp(-np.clip(z[own] @ logit[key], -30, 30))) if key in fine else z[own] @ linear_m[key]
                    how[at[own]] = "logistic" if key in fine else "ridge"
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(l), pa.array(m), pa.array(how.tolist(), pa.string())], names=[*batch.schema.names, "l", "m", "learner_m"])

    return rows.mapInArrow(fitted, schema)


def forest_nuisances(trees: int = 20, depth: int = 5, seed: int = SEED) -> Nuisances:
    """Random forests: a regressor for l, and for m a classifier, or a regressor where the other folds hold one treatment alone."""
    def fit(rows: DataFrame, folds: int) -> DataFrame:
        given, out = _vectors(rows), []
        names = [(r["concept"], r["rep"]) for r in rows.select("concept", "rep").distinct().collect()]  # concepts and repetitions are settings
        for name, rep in sorted(names):
            own = given.where((F.col("concept") == name) & (F.col("rep") == rep))
            for f in range(folds):
                train, test = own.where(F.col("fold") != f), own.where(F.col("fold") == f)
                known = dict(featuresCol="_v", numTrees=trees, maxDepth=depth, seed=seed)
                scored = RandomForestRegressor(labelCol="y", predictionCol="l", **known).fit(train).transform(test)
                if train.select("d").distinct().count() > 1:
                    model = RandomForestClassifier(labelCol="d", predictionCol="_p", rawPredictionCol="_raw", probabilityCol="_chance", **known).fit(train)
                    scored = model.transform(scored).withColumn("m", vector_to_array("_chance")[1]).withColumn("learner_m", F.lit("forest classifier"))
                else:
                    scored = RandomForestRegressor(labelCol="d", predictionCol="m", **known).fit(train).transform(scored).withColumn("learner_m", F.lit("forest regressor"))
                out.append(scored.select(*rows.columns, "l", "m", "learner_m"))
        return reduce(DataFrame.unionByName, out)

    return fit


def _vectors(rows: DataFrame) -> DataFrame:
    names = [f"_x{i}" for i in range(len(CONFOUNDERS))]
    flat = rows.select("*", *(F.col("x")[i].alias(n) for i, n in enumerate(names)))
    return VectorAssembler(inputCols=names, outputCol="_v").transform(flat).drop(*names)


def folded(panel: DataFrame, folds: int, reps: int, by_query: bool, seed: int) -> DataFrame:
    """concept, query_id, doc_id, rep, fold, d, y, x: confounders to mean 0 and deviation 1; rows that lack one are left out."""
    rows = panel.dropna(subset=["ce_score", "d", *CONFOUNDERS])
    sums = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in CONFOUNDERS), *(F.stddev_pop(c).alias(f"s_{c}") for c in CONFOUNDERS))
    scaled = F.array(*(F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0) for c in CONFOUNDERS))
    parts = [F.lit(seed), F.lit("fold"), F.col("rep"), F.col("query_id")] + ([] if by_query else [F.col("doc_id")])
    out = rows.join(F.broadcast(sums)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return out.select("concept", "query_id", "doc_id", "rep", (draw(*parts) % folds).cast("int").alias("fold"), F.col("d").cast("double").alias("d"), F.col("ce_score").cast("double").alias("y"), scaled.alias("x"))


def dml_plr_learned(panel: DataFrame, nuisances: Nuisances = ridge_nuisances, folds: int = FOLDS, reps: int = REPS, by_query: bool = False, seed: int = SEED) -> DataFrame:
    """concept, dml_coef, dml_se, ends, dml_pval, learner_m: the median over repetitions, nuisances from the other folds.

    Folds are drawn by row, or by query with `by_query`. A concept that none or all rows
    have gives no row.
    """
    rows = scratch(folded(panel, folds, reps, by_query, seed), "folds")
    fitted = scratch(nuisances(rows, folds), "nuisances")
    out = estimates(fitted.select("concept", "rep", (F.col("y") - F.col("l")).alias("u"), (F.col("d") - F.col("m")).alias("v")))
    both = fitted.groupBy("concept").agg(F.countDistinct("d").alias("kinds"), F.array_join(F.array_sort(F.collect_set("learner_m")), ", ").alias("learner_m")).where("kinds > 1")

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, se = (batch.column(c).to_pylist() for c in ("dml_coef", "dml_se"))
            p = [None if x is None or not s else round(math.erfc(abs(x / s) / math.sqrt(2)), 6) for x, s in zip(b, se, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "dml_pval"])

    out = out.mapInArrow(chance, T.StructType([*out.schema, T.StructField("dml_pval", T.DoubleType())]))
    return out.join(both.select("concept", "learner_m"), "concept")
