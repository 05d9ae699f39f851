"""Operators that avoid one task, one reducer or nested loops, against plain loops."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagefork.operators import inference as I, interventions as V
from stagefork.operators.quantiles import quantiles
from stagefork.operators.worlds import Retrieval
from stagefork.sources import collection as C

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("buckets", [4, 256])
def test_quantiles_equal_numpy(spark, buckets):
    """Ties that fill most buckets, one value alone, nulls, negative values, and a group of nulls alone."""
    rng = np.random.default_rng(buckets)
    groups = {"a": rng.normal(size=501).tolist(), "b": [1.0] * 300 + [2.0] * 2 + [0.5], "c": [7.0], "d": rng.integers(-5, 5, 400).astype(float).tolist(), "e": []}
    made = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)], "g string, v double")
    shares = (0.0, 0.1, 0.25, 0.5, 0.975, 1.0)
    got = dict(rows(quantiles(made, ["g"], "v", shares, buckets)))
    assert got.keys() == {"a", "b", "c", "d"}
    for g, q in got.items():
        assert q == pytest.approx(np.quantile(groups[g], shares), abs=1e-12)
    everything = [v for vs in groups.values() for v in vs]
    assert rows(quantiles(made, [], "v", shares, buckets))[0][0] == pytest.approx(np.quantile(everything, shares), abs=1e-12)
    assert quantiles(made.limit(0), ["g"], "v", shares).count() == 0


def hashed(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("block", [4, 5, 4096])
def test_replicates_by_plain_draws(spark, block):
    clusters = [(100 + i, float(i * i), i + 1) for i in range(13)]
    made = spark.createDataFrame(clusters, "query_id long, s double, n long").repartition(4)
    blocks = [clusters[i:i + block] for i in range(0, len(clusters), block)]
    want = {}
    for rep in range(20):
        if len(blocks) == 1:
            drawn = [blocks[0][hashed(7, "boot", rep, j) % 13] for j in range(13)]
        else:
            counts = Counter(hashed(7, "block", rep, i) % 13 // block for i in range(13))
            drawn = [blocks[b][hashed(7, "boot", rep, b, j) % len(blocks[b])] for b, k in counts.items() for j in range(k)]
        assert len(drawn) == 13
        want[rep] = (sum(c[1] for c in drawn), sum(c[2] for c in drawn))
    got = {r["rep"]: (r["s"], r["n"]) for r in I.replicates(made, 20, 7, ["s", "n"], block).collect()}
    assert got == want


def test_intervals_in_blocks_cover_the_mean(spark, monkeypatch):
    """Forty normal samples of 60 clusters: nearly all intervals hold the mean, and their width is that of the normal one."""
    monkeypatch.setattr(I.replicates, "__defaults__", (16,))
    rng, covered, widths = np.random.default_rng(4), [], []
    for k in range(6):
        x = rng.normal(3.0, 1.0, 60)
        log = spark.createDataFrame([(i, "treatment", float(v)) for i, v in enumerate(x)], "query_id long, arm string, v double")
        row = I.bootstrap_ci(log, "v", n=300, seed=k).where("arm = 'treatment'").first()
        covered.append(row.lo <= 3.0 <= row.hi)
        widths.append(row.hi - row.lo)
    assert np.mean(covered) >= 5 / 6 and np.mean(widths) == pytest.approx(2 * 1.96 / 60**0.5, rel=0.25)


@pytest.mark.parametrize("key_words", [1, 3, 4])
def test_holding_by_plain_loops(spark, key_words):
    """Items that begin and end inside words, of one to many words, with runs of spaces, repeated and empty ones."""
    rng = random.Random(key_words)
    docs = [(i, " ".join(rng.choices(["ab", "b", "abc", "c d", "a"], k=rng.randrange(0, 40)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "x  two  spaces y"), (103, "end\nof line here"), (104, "ab ab ab ab ab ab ab"), (105, " lead"), (106, "lead trail ")]
    items = [(i, d[a:a + n]) for i in range(60) for d in [rng.choice(docs[:60])[1]] for a in [rng.randrange(max(1, len(d)))] for n in [rng.randrange(0, 30)]]
    items += [(200, None), (201, ""), (202, "two  spaces"), (203, "two spaces"), (204, "d\nof li"), (205, "ab ab ab ab"), (206, " lead"), (207, "trail "), (208, "zz"), (209, "b")]
    want = {(q, d) for q, item in items if item is not None for d, text in docs if text is not None and item in text}
    got = rows(C.holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "query_id long, item string"), key_words))
    assert len(got) == len(set(got)) and set(got) == want


def test_holding_has_no_nested_loop(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id as query_id", "text as item")
    plan = C.holding(spark.read.parquet(f"{SF}/documents.parquet"), items)._jdf.queryExecution().optimizedPlan().toString()
    # What is left without keys are one-row tables of lengths.
    assert plan.count("Join Inner\n") <= 2 and "contains" in plan.lower()


def test_the_last_judgement_holds(spark):
    made = spark.createDataFrame([(1, 5, 2, 10), (1, 5, 0, 30), (1, 5, 9, 20), (1, 6, 1, 1), (2, 5, 3, 2), (2, 5, None, 9)], "query_id long, doc_id long, rel int, place int")
    assert set(rows(C.fold_judgements(made))) == {(1, 5, 0), (1, 6, 1), (2, 5, 3)}


@pytest.mark.parametrize("draws", [1, 3, 24])
def test_controls_by_number_and_from_the_rest(spark, monkeypatch, draws):
    """Every target gets as many as it can, all admissible, whether its draws run out or not."""
    r = Retrieval(spark, SF)
    found, words = V.targets(r), V.word_vocabulary(r)
    got = rows(V.control_terms(r, found, words, draws=draws).select("query_id", "doc_id", "term"))
    pool = {x.term for x in words.where("in_control_pool").collect()}
    taken = {(x.query_id, x.doc_id): set(x.tokens) | set(x.query_text.split()) for x in found.join(r.docs.select("doc_id", "tokens"), "doc_id").collect()}
    by = Counter((q, d) for q, d, _ in got)
    assert len(got) == len(set(got)) and all(t in pool - taken[q, d] for q, d, t in got)
    assert by == {k: min(V.TERMS, len(pool - own)) for k, own in taken.items()}
    left = dict(((q, d), n) for q, d, n in rows(V.control_admissible(r, found, words)))
    assert left == {k: len(pool - own) for k, own in taken.items()}


def test_stems_bar_inflections(spark):
    r = Retrieval(spark, SF, stem=True)
    found, words = V.targets(Retrieval(spark, SF)), V.word_vocabulary(r)
    stems = {x.term: x.form for x in V.control_pool(r, words).collect()}
    own = {(x.query_id, x.doc_id): {stems.get(t, t) for t in x.tokens} for x in found.join(r.docs.select("doc_id", "tokens"), "doc_id").collect()}
    for q, d, t in rows(V.control_terms(r, found, words).select("query_id", "doc_id", "term")):
        assert stems[t] not in own[q, d]


def test_vectors_take_no_shuffle(spark):
    from stagefork.operators.retrieval import hashed_vectors

    made = spark.createDataFrame([(1, "a bb cc bb"), (2, ""), (3, None), (4, "Wort für Wort")], "doc_id long, text string")
    df = hashed_vectors(made, "doc_id", "text")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: r for r in df.collect()}
    assert got.keys() == {1, 4} and all(r["norm"] == pytest.approx(np.linalg.norm(r["v"])) and len(r["v"]) == 64 for r in got.values())
    features = ["bb", "cc", "bb", "bb cc", "cc bb"]
    v = np.zeros(64)
    for f in features:
        h = int(hashlib.md5(f.encode()).hexdigest()[:8], 16)
        v[h % 64] += 1 - 2 * (h // 64 % 2)
    assert got[1]["v"] == v.tolist()


def test_pruned_scores_keep_every_best_document(spark):
    """Top documents with and without bounds, for texts of common, rare, repeated, unknown and no terms; some ranges are left out."""
    from stagefork.operators import retrieval as R

    rng = random.Random(1)
    posted = [(t, d, round(rng.random() ** 3 * (3 if d % 97 == 0 else 1) * w, 6)) for t, w, share in (("common", 1, 0.6), ("mid", 2, 0.2), ("rare", 5, 0.02), ("rarest", 9, 0.002)) for d in range(2000) if rng.random() < share]
    made = spark.createDataFrame(posted, "term string, doc_id long, contrib double").withColumn("contrib", F.col("contrib").cast(R.EXACT))
    texts = spark.createDataFrame([(t,) for t in ("common", "common mid", "rare common", "rarest common mid", "mid mid rare", "unknown common", "unknown", "rarest")], "text string")
    bounded = R.bounds(made, 10, 16)
    first = spark.range(20).withColumnRenamed("id", "doc_id")
    best = lambda scores: sorted(rows(R.top(scores, "bm25", texts, R.bm25_scores(texts, made.join(first, "doc_id", "left_semi")), first, 10)))
    assert best(R.pruned_bm25_scores(texts, made, bounded, width=16)) == best(R.bm25_scores(texts, made))
    report = {r["text"]: r for r in R.pruning(texts, bounded).collect()}
    assert report["rare common"]["postings_read"] < report["rare common"]["postings"] and report["rarest"]["ranges_read"] == report["rarest"]["ranges"]
    assert sum(r["postings_read"] for r in report.values()) < 0.8 * sum(r["postings"] for r in report.values())


def test_word_forms_are_tables(spark):
    from stagefork.operators import stability as S

    queries = spark.createDataFrame([(1, "Big mice run"), (2, "large, trees"), (3, "x")], "query_id long, query_text string")
    known = spark.createDataFrame([("mouse",), ("tree",), ("runs",)], "term string")
    synonyms = spark.createDataFrame([("big", "large"), ("large", "huge"), ("large", "vast")], "word string, other string")
    irregular = spark.createDataFrame([("mice", "mouse"), ("mouse", "mice")], "word string, other string")
    assert dict(rows(S.synonym_variants(queries, known, synonyms, irregular))) == {1: "Large mouse run", 2: "huge, tree", 3: "x"}
    assert dict(rows(S.synonym_variants(queries, known, synonyms.limit(0)))) == {1: "Big mice run", 2: "large, tree", 3: "x"}


def test_queries_with_one_text_keep_their_own_rows(spark):
    """Two queries of the same text get the rows that each gets alone, once."""
    r = Retrieval(spark, SF)
    text = r.queries.orderBy("query_id").first()["query_text"]
    alone = sorted(rows(r._factual(spark.createDataFrame([(7001, text)], "query_id int, query_text string")).drop("query_id")))
    both = r._factual(spark.createDataFrame([(7001, text), (7002, text)], "query_id int, query_text string")).cache()
    assert alone and all(sorted(rows(both.where(F.col("query_id") == q).drop("query_id"))) == alone for q in (7001, 7002))
    got = rows(r.pair_scores(both.select(F.col("query_text").alias("text"), "doc_id")))
    by_text = {d: s for _, d, s in rows(r.bm25(both.select(F.col("query_text").alias("text")).distinct()))}
    assert len(got) == len(alone) and all(bm25 == by_text.get(d, 0.0) for _, d, bm25, _ in got)


def test_best_lexical_documents_by_packs(spark, monkeypatch):
    """Packs of documents and of texts give the k best, ties included, and send on a small part of all scores."""
    from stagefork.operators import retrieval as R

    rng = random.Random(2)
    posted = [(t, d, round(rng.random() * w, places)) for t, w, share, places in (("common", 1, 0.7, 9), ("mid", 2, 0.2, 1), ("rare", 5, 0.02, 0), ("rarest", 9, 0.002, 3)) for d in range(3000) if rng.random() < share]
    made = spark.createDataFrame([(t, d * 10**6, c) for t, d, c in posted], "term string, doc_id long, contrib double").withColumn("contrib", F.col("contrib").cast(R.STORED))
    texts = spark.createDataFrame([(t,) for t in ("common", "common mid", "mid", "rare common", "rarest common mid", "mid mid rare", "unknown common", "unknown", "", "rarest")], "text string")
    first = made.select("doc_id").distinct().orderBy("doc_id").limit(20)
    every = R.bm25_scores(texts, made)
    best = lambda scores: sorted(rows(R.top(scores, "bm25", texts, R.bm25_scores(texts, made.join(first, "doc_id", "left_semi")), first, 10)))
    want = best(every)
    for pack, terms in ((1024, 8192), (100, 3), (1, 1)):
        monkeypatch.setattr(R, "PACK", pack)
        monkeypatch.setattr(R, "PACK_TERMS", terms)
        got = R.top_bm25_scores(texts, made, 300 if pack == 1 else 3000, k=10)
        assert best(got) == want
    monkeypatch.undo()
    assert R.top_bm25_scores(texts, made, 3000, k=10).count() < 0.2 * every.count()


def test_terms_are_counted_where_they_are(spark):
    """Counts of a document's terms take no shuffle, and postings are dealt out by term alone."""
    from stagefork.operators import retrieval as R

    docs = [(1, "the cat the cat a dog".split()), (2, []), (3, ["cat"] * 5), (4, ["the"]), (5, ["naïve", "東京", "naïve"])]
    made = spark.createDataFrame([(i, float(len(t)), t) for i, t in docs], "doc_id long, doc_len double, tokens array<string>").repartition(2)
    want = {(i, float(len(t)), w, n) for i, t in docs for w, n in Counter(t).items() if w != "the"}
    stored = made.localCheckpoint()
    counted = R.term_counts(stored, ("the",))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert set(rows(counted)) == want == set(rows(R.term_counts(stored.coalesce(1), ("the",))))
    plan = R.postings(stored, parts=4)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" in plan and "doc_id" not in "".join(x.split("]")[0] for x in plan.split("hashpartitioning(")[1:])
    # A document of many tokens is a part of its own.
    long = spark.createDataFrame([(1, 1.0, ["x", "y"] * 100_000), (2, 1.0, ["x"]), (3, 1.0, ["y"] * 140_000)], "doc_id long, doc_len double, tokens array<string>").coalesce(1)
    assert set(rows(R.term_counts(long, ()))) == {(1, 1.0, "x", 100_000), (1, 1.0, "y", 100_000), (2, 1.0, "x", 1), (3, 1.0, "y", 140_000)}


def test_light_queries_write_no_table(spark, monkeypatch):
    from stagefork.plans.queries import queries
    from stagefork.sources import store

    def refuse(*_, **__):
        raise AssertionError("a table is written")

    monkeypatch.setattr(store, "move", refuse)
    monkeypatch.setattr(store, "_MADE", {})
    for name in ("corpus_scan", "tokenize", "content_tokens", "bm25_terms", "vocab_df"):
        assert queries()[name](spark, "/root/testdata/sf0.01").limit(1).count() == 1


def test_texts_are_neither_dealt_out_nor_kept_twice(spark):
    """Documents larger than what is broadcast stay where they are while items are looked up in them; tables hold tokens, not texts."""
    from stagefork.sources.store import scratch

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(200 << 10))
    try:
        docs = C.read(spark, "/root/testdata/sf0.01", "documents")
        items = spark.createDataFrame([(i, r["text"][:200]) for i, r in enumerate(docs.where("length(text) > 200").limit(5).collect())], "query_id int, item string")
        found = C.holding(docs, scratch(items, "items"))
        assert {q for q, _ in rows(found)} == set(range(5))
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "text" not in Retrieval(spark, SF).docs.columns


def test_postings_are_dealt_out_once(spark):
    """Counts of documents come with the rows or from a table, not from a second shuffle of the rows."""
    from stagefork.operators import retrieval as R

    made = spark.createDataFrame([(1, 2.0, ["x", "y"]), (2, 3.0, ["x", "x", "z"]), (3, 0.0, [])], "doc_id long, doc_len double, tokens array<string>").localCheckpoint()
    plain = R.postings(made, parts=4)
    assert plain._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(term") == 1
    assert set(rows(R.postings(made, parts=4, known=R.plain_vocabulary(made, 3)))) == set(rows(plain))
    assert {(r.term, r.doc_id, r.tf, r.df) for r in plain.collect()} == {("x", 1, 1, 2), ("y", 1, 1, 1), ("x", 2, 2, 2), ("z", 2, 1, 1)}


@pytest.mark.parametrize("stopwords", [("about",), None])
def test_words_by_the_vocabulary_equal_words_by_documents(spark, stopwords):
    r = Retrieval(spark, SF, **({} if stopwords is None else {"stopwords": stopwords}))
    want = Counter(t for _, t, _ in rows(V.doc_tf(r)))
    assert want and {w["term"]: w["df"] for w in V.word_vocabulary(r).collect()} == want
    one = r.qrels.select("doc_id").limit(1)
    assert set(rows(V.doc_tf(r, one))) == set(rows(V.doc_tf(r).join(one, "doc_id", "left_semi")))
