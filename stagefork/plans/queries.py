"""One query for each operator of the retrieval experiment, by name."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import index_terms, jaccard, tokenize
from ..operators import effects as E, inference as I, interventions as V, learned as L, mediation as M, retrieval as R, stability as S, verdict as D
from ..sources import artifacts as A, collection as C
from ..sources.store import file_system, shared_dir
from ..operators.worlds import Retrieval


def _texts(r: Retrieval) -> DataFrame:
    return r.queries.select(F.col("query_text").alias("text")).distinct()


def _named(r: Retrieval, rows: DataFrame) -> DataFrame:
    return rows.join(r.queries.withColumnRenamed("query_text", "text"), "text").drop("text")


def _single(r: Retrieval) -> DataFrame:
    texts = _texts(r)
    both = r.bm25_top(texts, 10).select("text", "doc_id", "rk", F.lit("bm25").alias("channel")).unionByName(
        r.dense_top(texts, 10).select("text", "doc_id", "rk", F.lit("dense").alias("channel")))
    return _named(r, both)


def _ndcg(r: Retrieval) -> DataFrame:
    full = r.baseline.select("query_id", "doc_id", F.col("n").alias("rank"), F.lit("full_pipeline").alias("channel"))
    one = _single(r).select("query_id", "doc_id", F.col("rk").alias("rank"), F.concat("channel", F.lit("_only")).alias("channel"))
    rows = full.unionByName(one)
    out = None
    for channel in ("bm25_only", "dense_only", "full_pipeline"):
        found = R.ndcg(rows.where(F.col("channel") == channel).drop("channel"), r.qrels).withColumn("channel", F.lit(channel))
        out = found if out is None else out.unionByName(found)
    return out


def _ndcg_summary(r: Retrieval) -> DataFrame:
    mean = lambda c: F.round(F.avg(F.when(F.col("channel") == c, F.col("ndcg").cast("decimal(38,12)"))).cast("double"), 9).alias(c)
    rows = _ndcg(r).agg(mean("bm25_only"), mean("dense_only"), mean("full_pipeline"), F.countDistinct("query_id").alias("n_queries"))
    return rows.withColumn("reranker_helps", F.col("full_pipeline") > F.greatest("bm25_only", "dense_only"))


def _select_prob(r: Retrieval) -> DataFrame:
    return V.treatment_candidates(r, V.targets(r), V.word_vocabulary(r))


def _admissible(r: Retrieval) -> DataFrame:
    return V.control_admissible(r, V.targets(r), V.word_vocabulary(r))


def _stemmed(r: Retrieval) -> Retrieval:
    return Retrieval(r.spark, r.sf_dir, stem=True)


def _admissible_stemmed(r: Retrieval) -> DataFrame:
    """Admissible control words of the plain run's targets, where inflections of a text's words are barred, too."""
    return V.control_admissible(_stemmed(r), V.targets(r), V.word_vocabulary(r))


def _bm25_terms_stemmed(r: Retrieval) -> DataFrame:
    return _bm25_terms(r).join(r.stems, "term").groupBy("stem").agg(F.sum("n").alias("n"))


def _given_judgements(r: Retrieval) -> DataFrame:
    """Each role of a conversation judged by the length of its turns, of which the last holds."""
    turns = C.read(r.spark, r.sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("doc_id"), F.length("text").alias("rel"), F.col("turn").alias("place"))
    return C.fold_judgements(turns)


def _extremes(r: Retrieval) -> DataFrame:
    """The least stable ranking of all queries and the path whose share shifts most, in one row."""
    shift = M.mediation_shift(_ratio(r)).agg(F.max(F.struct("shift_pp", "path")).alias("x")).select(F.col("x.path").alias("path"), F.col("x.shift_pp").alias("shift_pp"))
    return S.least_stable(S.stability_raw(r, None)).join(shift)


def _merged(r: Retrieval, shards: int = 4) -> DataFrame:
    """The baseline written shard by shard, checked for missing ones and merged."""
    path = f"{shared_dir(r.spark)}/shards-{uuid.uuid4().hex}"
    fs, where = file_system(r.spark, path)
    fs.deleteOnExit(where)
    A.write_shards(r.baseline.select("query_id", "doc_id", "rank"), r.queries, path, shards)
    return A.merge_shards(r.spark, path, shards, r.queries, keep=True)


def _control_terms(r: Retrieval) -> DataFrame:
    return V.injected(r).where("arm = 'control'").select("query_id", "doc_id", "term")


def _treatment_terms(r: Retrieval) -> DataFrame:
    return V.injected(r).where("arm = 'treatment'").select("query_id", "doc_id", "term")


def _pipeline_run(r: Retrieval) -> DataFrame:
    """The lexical channel alone, which the baseline doesn't show."""
    return r.run(r.plain(r.queries, "bm25")).select(F.col("world_id").alias("query_id"), "doc_id", "provenance", "ce", "rank")


def _ratio(r: Retrieval) -> DataFrame:
    return M.mediation_ratio(M.mediation_paths(r))


def _panel_compare(r: Retrieval) -> DataFrame:
    panel = E.dml_panel(r)
    return E.dml_compare(E.naive_ols(panel), E.dml_plr(panel))


def _criteria(r: Retrieval) -> DataFrame:
    ratio = _ratio(r)
    return D.criteria(I.bootstrap_diff_ci(V.intervention_log(r)), ratio, M.mediation_shift(ratio), _panel_compare(r))


def _bm25_terms(r: Retrieval) -> DataFrame:
    return r.corpus.select("doc_id", F.explode(index_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _postings(r: Retrieval) -> DataFrame:
    return r.postings.select("term", "doc_id", "tf", "df", F.round("idf", 9).alias("idf"), F.round(F.col("contrib").cast("double"), 6).alias("contrib"))


BUILDERS = {
    "corpus_scan": lambda r: r.corpus.select("doc_id", "title", F.length("text").alias("n_chars"), F.length("ce_text").alias("ce_chars"), "doc_len"),
    "tokenize": lambda r: r.corpus.select("doc_id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct")),
    "content_tokens": lambda r: r.corpus.select("doc_id", F.size("content_tokens").alias("n_content"), F.size(F.array_distinct("content_tokens")).alias("n_distinct")),
    "bm25_terms": _bm25_terms,
    "vocab_df": lambda r: r.corpus.select(F.explode(F.array_distinct("content_tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")),
    "doc_tf": V.doc_tf,
    "postings": lambda r: _postings(r),
    "qrels": lambda r: r.qrels,
    "query_texts": lambda r: r.queries,
    "bm25_scores": lambda r: _named(r, r.bm25(_texts(r))).where("bm25 > 0"),
    "bm25_topk": lambda r: _named(r, r.bm25_top(_texts(r))),
    "emb_norms": lambda r: r.doc_vectors.select("doc_id", F.round("norm", 9).alias("norm")),
    "dense_scores": lambda r: _named(r, r.dense(_texts(r))),
    "dense_topk": lambda r: _named(r, r.dense_top(_texts(r))),
    "topk_single": _single,
    "candidate_pool": lambda r: r.baseline.select("query_id", "doc_id", "provenance"),
    "rerank": lambda r: r.baseline.select("query_id", "doc_id", "ce"),
    "censored_rank": lambda r: r.baseline.select("query_id", "doc_id", "rank"),
    "pipeline_run": _pipeline_run,
    "full_top10": lambda r: r.baseline.where("n <= 10").select("query_id", "doc_id", F.col("n").alias("rank")),
    "baseline": lambda r: r.baseline.drop("n"),
    "ndcg": _ndcg,
    "ndcg_summary": _ndcg_summary,
    "targets": lambda r: V.targets(r).select("query_id", "doc_id"),
    "control_pool": lambda r: V.word_vocabulary(r).where("in_control_pool").select("term", "df", F.round("idf", 9).alias("idf")),
    "control_admissible": _admissible,
    "treatment_candidates": lambda r: _select_prob(r).select("query_id", "doc_id", "term", "tf", "weight"),
    "select_prob": lambda r: _select_prob(r).select("query_id", "doc_id", "term", "select_prob", "n_candidate_terms"),
    "treatment_terms": _treatment_terms,
    "control_terms": _control_terms,
    "injected_queries": lambda r: V.injected(r).select("query_id", "doc_id", "term", "arm", "injected_query"),
    "term_provenance": V.term_provenance,
    "intervention_log": V.intervention_log,
    "origin_documents": lambda r: V.origin_documents(r, V.intervention_log(r)),
    "design_checks": lambda r: V.design_checks(V.intervention_log(r)),
    "run_counts": lambda r: V.run_counts(V.intervention_log(r)),
    "arm_means": lambda r: I.arm_means(V.intervention_log(r)),
    "cluster_stats": lambda r: I.cluster_sums(V.intervention_log(r)),
    "bootstrap_ci": lambda r: I.bootstrap_ci(V.intervention_log(r)),
    "bootstrap_diff_ci": lambda r: I.bootstrap_diff_ci(V.intervention_log(r)),
    "contrast_uncensored": lambda r: I.contrast_uncensored(V.intervention_log(r)),
    "delta_rank_hist": lambda r: I.delta_rank_hist(V.intervention_log(r)),
    "mediation_paths": M.mediation_paths,
    "mediation_ratio": _ratio,
    "mediation_shift": lambda r: M.mediation_shift(_ratio(r)),
    "jaccard": lambda r: r.queries.join(r.qrels, "query_id").join(r.docs, "doc_id").select("query_id", "doc_id", F.round(jaccard(tokenize(F.col("query_text")), F.col("tokens")), 9).alias("jaccard")),
    "rbo": lambda r: S.stability_raw(r).select("query_id", "variant", "config", "rbo"),
    "corpus_vocab": S.corpus_words,
    "variant_destop": lambda r: r.queries.select("query_id", S.destopped(F.col("query_text")).alias("variant_text")),
    "variant_shuffle": lambda r: r.queries.select("query_id", S.shuffled(F.col("query_text"), F.col("query_id")).alias("variant_text")),
    "variant_synonym": lambda r: S.synonym_variants(r.queries, S.corpus_words(r), S.stem_mates(r)),
    "word_forms": S.stem_mates,
    "bm25_pruning": lambda r: _named(r, R.pruning(_texts(r), r.bounds)),
    "stability_raw": S.stability_raw,
    "stability_summary": lambda r: S.stability_summary(S.stability_raw(r)),
    "stability_noop": lambda r: S.stability_noop(S.stability_raw(r)),
    "rbo_box_stats": lambda r: S.rbo_box_stats(S.stability_raw(r)),
    "concept_terms": E.concept_terms,
    "dml_panel": E.dml_panel,
    "naive_ols": lambda r: E.naive_ols(E.dml_panel(r)),
    "dml_plr": lambda r: E.dml_plr(E.dml_panel(r)),
    "dml_compare": _panel_compare,
    "dml_plr_learned": lambda r: L.dml_plr_learned(E.dml_panel(r), by_query=True),
    "criteria": _criteria,
    "verdict": lambda r: D.verdict(_criteria(r)),
    "shard_merge": _merged,
    "shard_of": lambda r: A.shard_of(r.queries, 4),
    "term_stems": lambda r: r.stems,
    "bm25_terms_stemmed": _bm25_terms_stemmed,
    "postings_stemmed": lambda r: _postings(_stemmed(r)),
    "bm25_topk_stemmed": lambda r: _named(r, _stemmed(r).bm25_top(_texts(r))),
    "control_admissible_stemmed": _admissible_stemmed,
    "qrels_fold": _given_judgements,
    "extremes": _extremes,
}


def queries() -> dict:
    return {name: (lambda spark, sf_dir, build=build: build(Retrieval(spark, sf_dir))) for name, build in BUILDERS.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["baseline"](spark, sf_dir)
