"""Artefacts by what they hang on, tables that grow, and runs that go on where they broke off."""

import shutil

import pytest
from pyspark.sql import functions as F

from stagefork.operators import interventions as V
from stagefork.plans import run as P
from stagefork.operators import retrieval as R
from stagefork.operators.worlds import Retrieval
from stagefork.sources import artifacts as A, store as T

SF = "/root/testdata/sf0.001"


@pytest.fixture
def kept(spark, tmp_path):
    """A store of its own, as `spark.stagefork.store` names one."""
    spark.conf.set(T.STORE, str(tmp_path / "store"))
    yield tmp_path
    spark.conf.unset(T.STORE)


def forget(spark):
    """What a new session knows: nothing in memory, and an empty catalog."""
    T._MADE.clear()
    for t in spark.catalog.listTables():
        if t.name.startswith("stagefork_"):
            spark.sql(f"DROP TABLE {t.name}")


def test_a_later_session_reads_what_an_earlier_one_wrote(spark, kept):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    for _ in range(2):
        assert T.stage_table(spark, "t", "data", build, {"k": 1}).count() == 5
        forget(spark)
    assert len(calls) == 1
    T.stage_table(spark, "t", "data", build, {"k": 2})
    T.stage_table(spark, "t", "other data", build, {"k": 1})
    assert len(calls) == 3


def test_a_broken_write_is_not_read(spark, kept):
    path = T.place(spark, T.artefact_name("t", "data", [None, None]))
    spark.range(3).write.parquet(path)
    (kept / "store" / path.rsplit("/", 1)[1] / "_SUCCESS").unlink()
    assert T.stage_table(spark, "t", "data", lambda: spark.range(7)).count() == 7


def test_changed_input_is_not_served_old_tables(spark, kept):
    data = kept / "data"
    data.mkdir()
    for t in ("documents", "benchmark", "labels"):
        shutil.copy(f"{SF}/{t}.parquet", data / f"{t}.parquet")
    assert Retrieval(spark, str(data)).n_docs == 200
    spark.read.parquet(f"{SF}/documents.parquet").limit(150).coalesce(1).write.parquet(str(kept / "fewer"))
    (data / "documents.parquet").unlink()
    shutil.move(str(next((kept / "fewer").glob("part-*"))), data / "documents.parquet")
    assert Retrieval(spark, str(data)).n_docs == 150


def test_scoring_shuffles_no_postings(spark, kept):
    """Postings are bucketed by term, in a later session, too: a join with them by term has no exchange on their side."""
    want = {tuple(x) for x in Retrieval(spark, SF).postings.collect()}
    forget(spark)
    r = Retrieval(spark, SF)
    assert {tuple(x) for x in r.postings.collect()} == want
    texts = r.queries.select(F.col("query_text").alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = r.bm25(texts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = [line for line in plan.split("== Initial Plan ==")[-1].splitlines() if "Bucketed: true" in line]
    assert scan and plan.count("Exchange hashpartitioning(term") == 1


def test_a_run_keeps_postings_of_its_terms_alone(spark, kept):
    """Scores need no table of all postings; those of the asked terms equal its rows, and a text of the same terms makes none anew."""
    r = Retrieval(spark, SF)
    texts = r.queries.select(F.col("query_text").alias("text"))
    asked = [x["term"] for x in R.query_terms(texts).select("term").distinct().collect()]
    found = r.posted(texts)
    assert r.posted(texts.limit(1)) is found
    assert r.baseline.count() and r.doc_vectors.count()
    assert not list((kept / "store").glob("postings-*"))
    got = sorted(map(tuple, found.collect()))
    assert {x[0] for x in got} == set(asked)
    assert got == sorted(map(tuple, r.postings.where(F.col("term").isin(*asked)).select(*found.columns).collect()))
    assert sorted(map(tuple, r.doc_vectors.collect())) == sorted(map(tuple, R.hashed_vectors(r.corpus, "doc_id", "text").collect()))


def test_baseline_runs_only_queries_that_lack(spark, kept, monkeypatch):
    worlds = []
    run = Retrieval.run
    monkeypatch.setattr(Retrieval, "run", lambda self, w: (worlds.append(w.count()), run(self, w))[1])
    r = Retrieval(spark, SF)
    all_, first = r.queries, r.queries.orderBy("query_id").limit(1)
    n = all_.count()
    one = r.baseline_of(first)
    assert worlds == [1] and one.select("query_id").distinct().count() == 1
    whole = sorted(map(tuple, r.baseline_of(all_).collect()))
    assert worlds == [1, n - 1] and len({x[0] for x in whole}) == n
    forget(spark)
    again = Retrieval(spark, SF)
    assert sorted(map(tuple, again.baseline_of(all_).collect())) == whole and worlds == [1, n - 1]
    changed = first.withColumn("query_text", F.concat("query_text", F.lit(" again")))
    assert {x["query_text"] for x in again.baseline_of(changed).collect()} == {x["query_text"] for x in changed.collect()} and worlds == [1, n - 1, 1]


def test_a_broken_run_goes_on_and_ends_right(spark, tmp_path, monkeypatch):
    few = dict(list(P.STAGES.items())[:6])
    monkeypatch.setattr(P, "STAGES", few)
    out = str(tmp_path / "out")
    first = P.Run(spark, SF, out, shards=2, least_ndcg=0.0)
    log = V.intervention_log

    def breaks(r):
        if r.shard == (1, 2):
            raise RuntimeError("lost")
        return log(r)

    monkeypatch.setattr(V, "intervention_log", breaks)
    with pytest.raises(RuntimeError):
        first.run()
    assert first.made == ["baseline", "ndcg", "log_shards/of2/shard=0"]
    monkeypatch.setattr(V, "intervention_log", log)
    second = P.Run(spark, SF, out, shards=2, least_ndcg=0.0)
    tables = second.run()
    assert second.made == ["log_shards/of2/shard=1", "interventions", "origin_documents", "arm_means", "contrast"]
    # Shards together are the log of a run without any.
    whole = log(Retrieval(spark, SF))
    assert sorted(map(str, tables["interventions"].select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    third = P.Run(spark, SF, out, shards=2, least_ndcg=0.0)
    third.run()
    assert third.made == []
    changed = P.Run(spark, SF, out, shards=2, settings={"note": 1}, least_ndcg=0.0)
    assert not changed.finished("baseline") and changed.run(only=("baseline",)).keys() == few.keys()
    text = P.report(third)
    assert "## Limitations" in text and "No artefact `effects`" in text and "Not judged" in text and "| arm |" in text
    with pytest.raises(ValueError, match="below 2"):
        P.Run(spark, SF, out, shards=2, least_ndcg=2.0).run(only=("ndcg",))


def test_shards_take_the_place_of_earlier_ones(spark, tmp_path):
    path = str(tmp_path / "shards")
    queries = spark.range(6).withColumnRenamed("id", "query_id")
    A.write_shards(queries.withColumn("x", F.lit(1)), queries, path, 3)
    A.write_shard(queries.where("query_id % 3 = 1").withColumn("x", F.lit(2)), path, 1)
    found = {r["query_id"]: (r["x"], r["shard"]) for r in A.merge_shards(spark, path, 3, keep=True).collect()}
    assert found == {i: (2 if i % 3 == 1 else 1, i % 3) for i in range(6)}
    with pytest.raises(ValueError):
        A.merge_shards(spark, path, 4)
    assert A.merge_shards(spark, path, 9, queries.where("query_id < 3")).count() == 6


def test_rows_are_numbered_without_a_window_over_all(spark):
    rows = spark.range(1000).select((1000 - F.col("id")).alias("a"), F.concat(F.lit("x"), F.col("id") % 7).alias("b")).repartition(5)
    got = [r["number"] for r in T.numbered(rows, "a").orderBy("a").collect()]
    assert got == list(range(1000))
    both = T.numbered(rows, "b", "a", to="n").orderBy("b", "a").collect()
    assert [r["n"] for r in both] == list(range(1000))
    assert T.numbered(rows.limit(0), "a").count() == 0


def test_manifest_has_metadata(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "t"))
    rows = A.manifest(spark, str(tmp_path / "t"), {"code": "abc", "settings": {"k": 1}}).collect()
    assert {r["path"]: r["sha256"] for r in rows if r["path"].startswith("meta:")} == {"meta:code": '"abc"', "meta:settings": '{"k": 1}'}
    assert all(len(r["sha256"]) == 16 for r in rows if r["path"].endswith(".parquet"))
