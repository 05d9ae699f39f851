"""The experiment's invariants, and every query against its SQL, on the smallest tables."""

from collections import Counter
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from stagefork.operators import effects as E, inference as I, interventions as V, mediation as M, retrieval as R, stability as S, verdict as D
from stagefork.plans import oracle, queries
from stagefork.operators.worlds import Retrieval
from stagefork.sources import artifacts as A
from stagefork.streaming.live import serve

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def r(spark):
    return Retrieval(spark, DATA)


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return out


def canon(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(canon, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", [n for n in queries.BUILDERS if n in oracle.sql()])
def test_equals_sql(spark, con, name):
    df = queries.queries()[name](spark, DATA)
    got = con.execute(oracle.sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    want = Counter(tuple(canon(row[i]) for i in order) for row in got.fetchall())
    assert Counter(tuple(map(canon, row)) for row in df.collect()) == want


def test_controls_leave_bm25_alone(r):
    assert V.intervention_log(r).where("arm = 'control' and delta_bm25 != 0").count() == 0


def test_control_terms_are_in_neither_text(r):
    rows = V.injected(r).where("arm = 'control'").join(r.docs.select("doc_id", "tokens"), "doc_id")
    assert rows.where(F.array_contains("tokens", F.col("term"))).count() == 0


def test_lexical_worlds_have_no_residual(r):
    assert M.mediation_paths(r).where("cfg = 'bm25' and residual != 0").count() == 0


def test_shuffles_leave_bm25_alone(r):
    assert S.stability_raw(r).where("variant = 'shuffle' and config = 'bm25' and rbo != 1").count() == 0


def test_ranks_and_pools(r):
    assert r.baseline.where(~F.col("rank").between(1, R.K + 1)).count() == 0
    assert r.baseline.groupBy("query_id").agg(F.sum(F.when(F.col("provenance") != "dense_only", 1)).alias("n")).where(F.col("n") != R.K).count() == 0


def test_texts_without_matches_are_filled(spark, r):
    texts = spark.createDataFrame([("zzzzqqqq",)], "text string")
    got = [x.doc_id for x in r.bm25_top(texts).orderBy("rk").collect()]
    assert got == [x.doc_id for x in r.first_docs.orderBy("doc_id").limit(R.K).collect()]


def test_partitions_do_not_matter(spark, r):
    want = sorted(map(tuple, r.bm25_top(r.queries.select(F.col("query_text").alias("text"))).collect()))
    for n in (1, 3, 8):
        posted = r.postings.repartition(n)
        texts = r.queries.select(F.col("query_text").alias("text")).repartition(n)
        scores = R.bm25_scores(texts, posted)
        assert sorted(map(tuple, R.top(scores, "bm25", texts, scores, r.first_docs).collect())) == want


def log(spark, rows):
    return spark.createDataFrame(rows, "query_id long, arm string, delta_rank int, base_censored boolean")


def test_bootstrap_edges(spark):
    one = I.bootstrap_ci(log(spark, [(1, "treatment", 4, False), (1, "treatment", 2, False)]), n=50).where("arm = 'treatment'").first()
    assert (one.point, one.lo, one.hi) == (3.0, 3.0, 3.0)
    both = I.bootstrap_diff_ci(log(spark, [(1, "treatment", 5, False), (1, "control", 1, False), (2, "treatment", 9, False)]), n=50).first()
    assert (both.point, both.n_clusters) == (4.0, 1)
    none = I.bootstrap_diff_ci(log(spark, []), n=5).first()
    assert none.point is None and none.n_clusters == 0


def test_ndcg_edges(spark):
    qrels = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (2, 12, 0)], "query_id long, doc_id long, rel int")
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query_id long, doc_id long, rank int")
    assert dict(map(tuple, R.ndcg(ranking, qrels).collect())) == {1: 1.0, 2: 0.0}


def test_any_statistic(spark):
    rows = I.any_statistic(log(spark, [(1, "control", 1, False), (1, "control", 5, False)]), lambda s: s.max() - s.min()).collect()
    assert rows[0].stat == 4.0


def test_folds_by_query(r):
    panel = E.dml_panel(r)
    assert E.dml_plr(panel, by_query=True).count() == panel.select("concept").distinct().count()


def test_shards_and_manifest(spark, r, tmp_path):
    path = str(tmp_path / "shards")
    A.write_shards(r.baseline, r.queries, path, 2)
    assert A.merge_shards(spark, path, 2).count() == r.baseline.count()
    with pytest.raises(ValueError):
        A.merge_shards(spark, path, 3)
    assert A.manifest(spark, path).where("length(sha256) = 16").count() > 0
    A.write_csv(r.queries, str(tmp_path / "csv"))
    assert A.read_csv(spark, str(tmp_path / "csv"), "query_id long, query_text string").count() == r.queries.count()
    assert "| YES |" in A.markdown_table(spark.range(1).select(F.lit(True).alias("ok")))


def test_stream_of_queries(spark, r, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    r.queries.write.parquet(source)
    stream = spark.readStream.schema(r.queries.schema).parquet(source)
    serve(r, stream, out, str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(out).select("query_id", "doc_id", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, r.baseline.select("query_id", "doc_id", "rank").collect()))


def test_log_checks(r):
    found = D.failed_checks(V.intervention_log(r), D.log_checks()).collect()
    assert {x["check"]: x["n_failed"] for x in found} == dict.fromkeys(D.log_checks(), 0)


def test_extremes_take_all_queries(spark, monkeypatch):
    """Every query is rewritten for the extremes, those beyond the sample of the stability report, too, in code and SQL."""
    many = SimpleNamespace(queries=spark.range(120).selectExpr("id query_id", "cast(id as string) query_text"))
    assert S.sampled(many, None).count() == 120 and S.sampled(many).count() == S.QUERIES
    asked, raw = [], S.stability_raw
    monkeypatch.setattr(S, "stability_raw", lambda r, n=S.QUERIES: asked.append(n) or raw(r, n))
    assert queries.queries()["extremes"](spark, DATA).count() == 1 and asked == [None]
    assert " LIMIT 50" not in oracle.sql()["extremes"] and " LIMIT 50" in oracle.sql()["stability_raw"]
