"""Term injections with matched controls: a do-operator on the query text.

Draws are hashes of a seed and ids, so that samples don't hang on the order of work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.stem import stem_dimension
from ..functions.text import INDEX_STOPWORDS, WORD, draw, index_terms, jaccard, tokenize, uniform
from .worlds import Retrieval
from ..sources.store import numbered, scratch
from .retrieval import K, term_counts

SEED = 42
TARGETS, TERMS = 3, 3
POOL_LEAST, POOL_SHARE = 5, 0.20
#: Numbers that a target draws for its controls before it chooses from the rest.
DRAWS = 24


def word_vocabulary(r: Retrieval) -> DataFrame:
    """term, df, idf, in_control_pool of words: letters only, three or more, no stop words."""
    return r._table("words", lambda: _word_vocabulary(r), "inputs")


def _word_vocabulary(r: Retrieval) -> DataFrame:
    n = r.n_docs
    if set(INDEX_STOPWORDS) <= set(r.stopwords):
        df = r.unstemmed.vocabulary.where(F.col("term").rlike(WORD) & ~F.col("term").isin(*r.stopwords))
    else:
        df = doc_tf(r).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    pool = (F.col("df") >= POOL_LEAST) & (F.col("df") <= POOL_SHARE * n)
    return df.select("term", "df", F.log(F.lit(float(n)) / (1 + F.col("df"))).alias("idf"), pool.alias("in_control_pool"))


def doc_tf(r: Retrieval, of: DataFrame | None = None) -> DataFrame:
    """doc_id, term, tf of words, of the documents in `of` (doc_id) or of all.

    Not kept as a table, which would be as large as the postings: callers count the few documents that they need.
    """
    own = r.docs if of is None else r.docs.join(of.select("doc_id").distinct(), "doc_id", "left_semi")
    return term_counts(own, r.stopwords).where(F.col("term").rlike(WORD)).select("doc_id", "term", "tf")


def targets(r: Retrieval, most: int = TARGETS, seed: int = SEED) -> DataFrame:
    """query_id, query_text, doc_id: relevant documents in a query's pool, some at random if there are many."""
    def build():
        eligible = r.baseline.select("query_id", "query_text", "doc_id").join(r.qrels.where("rel >= 1").select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
        order = Window.partitionBy("query_id").orderBy(draw(seed, "target", F.col("query_id"), F.col("doc_id")), "doc_id")
        return eligible.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")

    # Written, so that its size is known where larger tables are joined to it.
    return r._table(f"targets_{most}_{seed}", build)


def treatment_candidates(r: Retrieval, found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query_id, doc_id, term, tf, weight, select_prob, n_candidate_terms: words of a target that its query lacks."""
    terms = doc_tf(r, found).join(found, "doc_id").join(vocabulary.select("term", "idf"), "term")
    named = found.select("query_id", "doc_id", F.explode(F.array_distinct(tokenize(F.col("query_text")))).alias("term"))
    left = terms.join(named, ["query_id", "doc_id", "term"], "left_anti").withColumn("weight", F.greatest(F.lit(0.0), F.col("tf") * F.col("idf")))
    own = Window.partitionBy("query_id", "doc_id")
    left = left.withColumn("weight", F.when(F.sum("weight").over(own) > 0, F.col("weight")).otherwise(1.0))
    share = F.col("weight") / F.sum(F.col("weight").cast("decimal(38,12)")).over(own).cast("double")
    return left.select("query_id", "doc_id", "term", "tf", F.round("weight", 9).alias("weight"), F.round(share, 9).alias("select_prob"), F.count(F.lit(1)).over(own).alias("n_candidate_terms"))


def treatment_terms(candidates: DataFrame, n: int = TERMS, seed: int = SEED) -> DataFrame:
    """Up to n terms a target by weighted sampling without replacement: smallest -ln(u) / weight."""
    u = uniform(seed, "treatment", F.col("query_id"), F.col("doc_id"), F.col("term"))
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.round(-F.log(u) / F.col("weight"), 9), "term")
    return candidates.where("weight > 0").withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).drop("n")


def _taken(r: Retrieval, found: DataFrame) -> DataFrame:
    """query_id, doc_id, view, form: what a target's document and query have, as words and, with stems, as stems."""
    words = found.join(r.docs.select("doc_id", "tokens"), "doc_id").select("query_id", "doc_id", F.explode(F.array_union("tokens", tokenize(F.col("query_text")))).alias("form"))
    own = words.withColumn("view", F.lit("word"))
    if not r.stem:
        return own
    stems = stem_dimension(words.where(~F.col("form").isin(*INDEX_STOPWORDS)), "form")
    return own.unionByName(words.join(stems, "form").select("query_id", "doc_id", F.col("stem").alias("form"), F.lit("stem").alias("view")).distinct())


def control_pool(r: Retrieval, vocabulary: DataFrame) -> DataFrame:
    """term, form, number: the pool's words, numbered from 0 in order; form is the stem with stems, else the word."""
    def build():
        pool = vocabulary.where("in_control_pool").select("term")
        return numbered(stem_dimension(pool).withColumnRenamed("stem", "form") if r.stem else pool.withColumn("form", F.col("term")), "term")

    return r._table("control_pool", build, "stem")


def _barred(r: Retrieval, found: DataFrame, pool: DataFrame) -> DataFrame:
    """query_id, doc_id, term: pool words that a target's document or query has, in either view of terms."""
    view = lambda name, c: pool.select("term", F.lit(name).alias("view"), F.col(c).alias("form"))
    forms = view("word", "term").unionByName(view("stem", "form"))
    return _taken(r, found).join(forms, ["view", "form"]).select("query_id", "doc_id", "term").distinct()


def control_admissible(r: Retrieval, found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query_id, doc_id, n_admissible: how many pool words neither query nor document has, by what they do have."""
    pool = control_pool(r, vocabulary)
    size = pool.agg(F.count(F.lit(1)).alias("pool"))
    barred = _barred(r, found, pool).groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("barred"))
    rows = found.select("query_id", "doc_id").join(barred, ["query_id", "doc_id"], "left").join(F.broadcast(size))
    return rows.select("query_id", "doc_id", (F.col("pool") - F.coalesce("barred", F.lit(0))).alias("n_admissible")).where("n_admissible > 0")


def control_terms(r: Retrieval, found: DataFrame, vocabulary: DataFrame, n: int = TERMS, seed: int = SEED, draws: int = DRAWS) -> DataFrame:
    """query_id, doc_id, term: up to n admissible pool words a target, drawn by number and drawn anew where rejected.

    Each target draws `draws` numbers, so the pool isn't held against every target. Only
    targets whose draws run out choose from all that is left of the pool, by a hash.
    """
    pool, key = control_pool(r, vocabulary), ["query_id", "doc_id"]
    barred, targets_ = _barred(r, found, pool), found.select(*key)
    size = pool.agg(F.count(F.lit(1)).alias("pool"))
    tries = targets_.join(F.broadcast(size)).where("pool > 0").select(*key, "pool", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("try"))
    tries = tries.select(*key, "try", (draw(seed, "control", F.col("query_id"), F.col("doc_id"), F.col("try")) % F.col("pool")).alias("number"))
    first = tries.groupBy(*key, "number").agg(F.min("try").alias("at")).join(pool.select("number", "term"), "number").join(barred, [*key, "term"], "left_anti")
    order = Window.partitionBy(*key)
    chosen = first.select(*key, "term", F.row_number().over(order.orderBy("at")).alias("n")).where(F.col("n") <= n)
    chosen = scratch(chosen, "control-draws")
    short = targets_.join(chosen.groupBy(*key).agg(F.count(F.lit(1)).alias("has")), key, "left").select(*key, F.coalesce("has", F.lit(0)).alias("has")).where(F.col("has") < n)
    numbers = short.join(F.broadcast(size)).where("pool > 0").select(*key, "has", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pool") - 1)).alias("number"))
    left = numbers.join(pool.select("number", "term"), "number").join(barred, [*key, "term"], "left_anti").join(chosen.select(*key, "term"), [*key, "term"], "left_anti")
    by_hash = order.orderBy(draw(seed, "control", F.col("query_id"), F.col("doc_id"), F.col("term")), "term")
    rest = left.withColumn("n", F.col("has") + F.row_number().over(by_hash)).where(F.col("n") <= n)
    return chosen.select(*key, "term").unionByName(rest.select(*key, "term"))


def injected(r: Retrieval) -> DataFrame:
    """query_id, query_text, doc_id, term, arm, injected_query and the sampling columns of each arm."""
    def build():
        found, words = targets(r), word_vocabulary(r)
        treated = treatment_terms(treatment_candidates(r, found, words)).select(
            "query_id", "doc_id", "term", F.lit("treatment").alias("arm"), F.lit("target_document").alias("term_source"), "select_prob", "n_candidate_terms", F.col("weight").alias("term_tfidf_weight"))
        pool = words.agg(F.count_if("in_control_pool").alias("pool"))
        control = control_terms(r, found, words).join(F.broadcast(pool)).select(
            "query_id", "doc_id", "term", F.lit("control").alias("arm"), F.lit("control_pool").alias("term_source"), (1 / F.col("pool")).alias("select_prob"), F.col("pool").alias("n_candidate_terms"), F.lit(0.0).alias("term_tfidf_weight"))
        both = treated.unionByName(control).join(found, ["query_id", "doc_id"])
        return both.withColumn("injected_query", F.concat_ws(" ", "query_text", "term"))

    return r._table("injected", build)


def term_provenance(r: Retrieval) -> DataFrame:
    """The audit columns of every injected term."""
    n = r.n_docs
    both = injected(r).select("doc_id", "term").distinct()
    # What is far larger meets the few injected terms and their documents first.
    tf = doc_tf(r, both).join(both, ["doc_id", "term"], "left_semi")
    titles = r.corpus.join(both.select("doc_id"), "doc_id", "left_semi").select("doc_id", "title")
    rows = injected(r).join(word_vocabulary(r), "term").join(tf, ["doc_id", "term"], "left").join(titles, "doc_id")
    rows = rows.join(stem_dimension(rows), "term") if r.stem else rows.withColumn("stem", F.col("term"))
    form = F.when(F.size(index_terms(F.col("term"))) > 0, F.col("stem")).otherwise("<stopword/dropped>")
    return rows.select(
        "query_id", "doc_id", "term", "arm", F.lit("append_term").alias("operator"), "term_source", F.coalesce("tf", F.lit(0)).alias("term_tf_in_doc"),
        F.col("df").alias("term_df_corpus"), F.round(100.0 * F.col("df") / n, 6).alias("term_doc_freq_pct"), F.round("idf", 9).alias("term_idf"),
        F.array_contains(tokenize(F.col("title")), F.col("term")).alias("term_in_title"),
        form.alias("term_bm25_form"),
        F.lit("end").alias("injection_position"), F.round("select_prob", 9).alias("select_prob"), "n_candidate_terms", "term_tfidf_weight")


def intervention_log(r: Retrieval) -> DataFrame:
    """A row for each injected term: ranks and scores of its target before and after, and covariates."""
    def build():
        rows = injected(r)
        texts = rows.select(F.col("injected_query").alias("world_id")).distinct()
        worlds = texts.select("world_id", *(F.col("world_id").alias(f"{s}_text") for s in ("bm25", "dense", "rerank")), F.lit("union").alias("first_stage"))
        after = r.run(worlds).select(F.col("world_id").alias("injected_query"), "doc_id", F.col("ce").alias("new_ce"), F.col("rank").alias("new_rank"), F.col("provenance").alias("provenance_new"))
        scores = r.pair_scores(rows.select(F.col("injected_query").alias("text"), "doc_id").distinct()).select(
            F.col("text").alias("injected_query"), "doc_id", F.col("bm25").alias("new_bm25"), F.col("dense").alias("new_dense"))
        before = r.baseline.select("query_id", "doc_id", F.col("rank").alias("base_rank"), F.col("ce").alias("base_ce"), F.col("bm25").alias("base_bm25"),
                                   F.col("dense").alias("base_dense"), F.col("provenance").alias("provenance_base"))
        own_docs = rows.select("doc_id").distinct()
        near = lambda table: table.join(own_docs, "doc_id", "left_semi")
        facts = near(r.docs.select("doc_id", "doc_len", "tokens")).join(near(r.doc_vectors.select("doc_id", "norm")), "doc_id", "left")
        all_ = rows.select("query_id", "query_text", "doc_id", "term", "arm", "injected_query").join(before, ["query_id", "doc_id"]).join(scores, ["injected_query", "doc_id"])
        all_ = all_.join(after, ["injected_query", "doc_id"], "left").join(facts, "doc_id")
        new_rank = F.coalesce("new_rank", F.lit(K + 1))
        own = tokenize(F.col("query_text"))
        return all_.join(term_provenance(r).drop("term_source", "arm"), ["query_id", "doc_id", "term"]).join(rows.select("query_id", "doc_id", "term", "term_source"), ["query_id", "doc_id", "term"]).select(
            "query_id", "doc_id", "term", "arm", "operator", "term_source", "term_tf_in_doc", "term_df_corpus", "term_doc_freq_pct", "term_idf", "term_in_title",
            "term_bm25_form", "injection_position", "select_prob", "n_candidate_terms", "term_tfidf_weight", "query_text", "injected_query",
            "base_rank", new_rank.alias("new_rank"), (F.col("base_rank") == K + 1).alias("base_censored"), (F.col("base_rank") - new_rank).alias("delta_rank"),
            "base_ce", "new_ce", F.round(F.col("new_ce") - F.col("base_ce"), 6).alias("delta_ce"),
            "base_bm25", "new_bm25", F.round(F.col("new_bm25") - F.col("base_bm25"), 9).alias("delta_bm25"),
            "base_dense", "new_dense", F.round(F.col("new_dense") - F.col("base_dense"), 9).alias("delta_dense"),
            F.col("new_ce").isNotNull().alias("in_candidates"), "provenance_base", F.coalesce("provenance_new", F.lit("none")).alias("provenance_new"),
            "doc_len", F.round(F.coalesce("norm", F.lit(0.0)), 9).alias("doc_emb_norm"), F.round(jaccard(own, F.col("tokens")), 9).alias("lex_overlap"), F.size(own).alias("query_len"))

    return r._table("interventions", build)


def origin_documents(r: Retrieval, log: DataFrame) -> DataFrame:
    """doc_id, title, text_snippet and lengths of the documents that the log's terms came from or aimed at."""
    ids = log.select("doc_id").distinct()
    return r.corpus.join(ids, "doc_id", "left_semi").select(
        "doc_id", "title", F.substring("text", 1, 400).alias("text_snippet"), F.length("text").alias("text_chars"),
        F.col("doc_len").cast("int").alias("doc_len_tokens"), F.size("content_tokens").alias("n_content_tokens"))


def design_checks(log: DataFrame) -> DataFrame:
    return log.agg(F.max(F.when(F.col("arm") == "control", F.abs("delta_bm25"))).alias("max_abs_delta_bm25_control"), F.round(F.avg(F.col("base_censored").cast("int")), 9).alias("censored_share"))


def run_counts(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("query_id").alias("n_queries"), F.countDistinct("query_id", "doc_id").alias("n_pairs"))
