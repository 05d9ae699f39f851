import numpy as np
import pytest
from pyspark.sql import functions as F

from stagefork.operators import retrieval as R, stability as S, verdict as D
from stagefork.operators.worlds import Retrieval
from stagefork.sources import artifacts as A, collection as C

SF = "/root/testdata/sf0.001"


def test_json_and_staleness(spark, tmp_path):
    path = str(tmp_path / "meta")
    meta = A.run_meta({"k": 20, "band": (0.05, 0.4)})
    assert A.read_json(spark, path) is None
    assert A.stale(spark, path, meta) == ["code", "settings", "spark"]
    A.write_json(spark, meta, path)
    assert A.stale(spark, path, meta) == []
    assert A.stale(spark, path, A.run_meta({"k": 10})) == ["settings"]


def test_missing_artifacts_are_none(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "there"))
    found = A.load_artifacts(spark, str(tmp_path), ("there", "absent"))
    assert found["there"].count() == 3 and found["absent"] is None


def test_shards_cover_all_rows_once(spark):
    rows = spark.range(20).select((F.col("id") % 7).alias("query_id"), "id")
    queries = rows.select("query_id").distinct()
    ids = [r["id"] for s in range(3) for r in A.shard_rows(rows, queries, s, 3).collect()]
    assert sorted(ids) == list(range(20))


@pytest.mark.parametrize("statuses, want", [(("PASS",) * 3, "yes"), (("FAIL", "PASS", "FAIL"), "no"), (("PASS", "INCONCLUSIVE", "FAIL"), "mixed")])
def test_verdict_text(spark, statuses, want):
    text = D.verdict_text(spark.createDataFrame(list(zip(("C1", "C2", "C3"), statuses)), "criterion string, status string"))
    assert f"**{want}**" in text and text.count("- **C") == 3 and ("1 open" in text) == ("INCONCLUSIVE" in statuses)


def test_checks_count_failures_and_nulls(spark):
    rows = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    found = {r["check"]: r["n_failed"] for r in D.failed_checks(rows, {"positive": F.col("x") > 0, "any": F.lit(True)}).collect()}
    assert found == {"positive": 2, "any": 0}
    assert D.failed_checks(rows, {}).count() == 0


def test_baseline_check(spark):
    rows = spark.createDataFrame([(0.5, None)], "bm25_only double, dense_only double")
    found = {r["channel"]: r["expected"] for r in D.baseline_check(rows, {"bm25_only": (0.4, 0.6), "dense_only": (0.0, 1.0)}).collect()}
    assert found == {"bm25_only": True, "dense_only": False}


@pytest.mark.parametrize("k", [None, 3])
def test_dense_packs_equal_plain_loops(spark, k, monkeypatch):
    monkeypatch.setattr(R, "PACK", 8)
    rng = np.random.default_rng(1)
    v, q = rng.integers(-3, 4, (50, 6)).astype(float), rng.integers(-3, 4, (9, 6)).astype(float)
    v[7] = q[2] = 0
    v[8] = v[9]
    table = {f"q{i}": q[i] for i in range(9)}
    docs = spark.createDataFrame([(i, float(np.sqrt(v[i] @ v[i])), v[i].tolist()) for i in range(50)], "doc_id long, norm double, v array<double>")
    texts = spark.createDataFrame([(t,) for t in table], "text string")
    encode = R.encoder(lambda words: np.array([table[w.removeprefix("ask ")] for w in words]), batch=4)
    first = docs.orderBy("doc_id").limit(6)
    cosine = {(t, i): round(float(x @ v[i]) / float(np.sqrt(x @ x) * np.sqrt(v[i] @ v[i])), 9) if x.any() and v[i].any() else 0.0 for t, x in table.items() for i in range(50)}
    got = R.dense_scores(texts, docs, encode, "ask ", k)
    if k is None:
        found = {(r["text"], r["doc_id"]): r["dense"] for r in got.collect()}
        assert found == pytest.approx({p: s for p, s in cosine.items() if ((table[p[0]] != 0) & (v[p[1]] != 0)).any()}, abs=2e-9)
        pairs = texts.crossJoin(docs.select("doc_id"))
        assert {(r["text"], r["doc_id"]): r["dense"] for r in R.pair_dense_scores(pairs, docs, encode, "ask ").collect()} == pytest.approx(cosine, abs=2e-9)
    else:
        best = {t: sorted(range(50), key=lambda i: (-cosine[t, i], i))[:k] for t in table}
        rows = R.top(got, "dense", texts, R.dense_scores(texts, docs.join(first, "doc_id", "left_semi"), encode, "ask "), first, k).collect()
        assert {t: [r["doc_id"] for r in sorted(rows, key=lambda r: r["rk"]) if r["text"] == t] for t in table} == best


def test_own_scorers_and_first_queries(spark):
    with pytest.raises(ValueError):
        Retrieval(spark, SF, first=3)
    letters = lambda texts: np.array([[t.count(c) for c in "aeiou"] for t in texts])
    overlap = lambda pairs: [float(len(set(a.split()) & set(b.lower().split()))) for a, b in pairs]
    r = Retrieval(spark, SF, R.encoder(letters), R.reranker(overlap), "find ", 3, "letters")
    rows = r.baseline.collect()
    assert 0 < len({x["query_id"] for x in rows}) <= 3 and all(x["ce"] == int(x["ce"]) for x in rows)
    assert all(1 <= x["rank"] <= R.K + 1 and -1 <= x["dense"] <= 1 for x in rows)


def test_variant_registry(spark):
    r = Retrieval(spark, SF)
    rows = S.variants(r, {"upper": lambda own, known: own.select("query_id", F.upper("query_text").alias("variant_text"))}).collect()
    assert rows and all(x["variant"] == "upper" and x["variant_text"] == x["query_text"].upper() for x in rows)


def test_stop_words_from_a_file(spark, tmp_path):
    """Another list gives other content tokens, in tables of their own; the usual ones stay."""
    usual = Retrieval(spark, SF)
    common = [r["term"] for r in usual.docs.select(F.explode("content_tokens").alias("term")).groupBy("term").count().orderBy(F.desc("count"), "term").limit(2).collect()]
    (tmp_path / "words.txt").write_text(f"{common[0].upper()}\n\n {common[1]} \n{common[1]}\n")
    own = C.words_of(spark, str(tmp_path / "words.txt"))
    assert own == tuple(sorted(common))
    other = Retrieval(spark, SF, stopwords=own)
    has = lambda r, term: r.docs.where(F.array_contains("content_tokens", term)).count()
    assert [has(other, t) for t in common] == [0, 0] and all(has(usual, t) for t in common) and has(other, "the") >= has(usual, "the")
    assert [tuple(x) for x in other.docs.select("doc_id", "doc_len").orderBy("doc_id").collect()] == [tuple(x) for x in usual.docs.select("doc_id", "doc_len").orderBy("doc_id").collect()]
