"""Rank stability under query rewrites."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranking import rbo
from ..functions.text import CONTENT_STOPWORDS, draw
from .worlds import Retrieval
from .quantiles import quantiles

QUERIES, TOP, DEGENERATE, SEED = 50, 10, 0.80, 42


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def destopped(text: Column, stopwords=CONTENT_STOPWORDS) -> Column:
    """Without stop words; a text of stop words alone stays."""
    own = words(text)
    left = F.filter(own, lambda w: ~F.regexp_replace(F.lower(w), "^[.,?!;:]+|[.,?!;:]+$", "").isin(*stopwords))
    return F.when(F.size(left) > 0, F.array_join(left, " ")).otherwise(text)


def shuffled(text: Column, key: Column, seed: int = SEED) -> Column:
    """Words in another order, by a hash of key and place; reversed if that gives the text again."""
    own = words(text)
    named = lambda w, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("shuffle"), key.cast("string"), i.cast("string")).cast("binary")).alias("h"), w.alias("w"))
    mixed = F.array_join(F.transform(F.array_sort(F.transform(own, named)), lambda x: x["w"]), " ")
    backwards = F.array_join(F.reverse(own), " ")
    return F.when(F.size(own) < 2, text).when(mixed == F.array_join(own, " "), backwards).otherwise(mixed)


def singular(word: Column) -> Column:
    return (F.when(word.endswith("ies"), F.concat(F.expr("left(w, length(w) - 3)"), F.lit("y"))).when(word.endswith("ses"), F.expr("left(w, length(w) - 2)"))
            .when(word.endswith("s"), F.expr("left(w, length(w) - 1)")).otherwise(word))


def plural(word: Column) -> Column:
    return (F.when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))).when(word.rlike("[^aeiou]y$"), F.concat(F.expr("left(w, length(w) - 1)"), F.lit("ies")))
            .otherwise(F.concat(word, F.lit("s"))))


def stem_mates(r: Retrieval) -> DataFrame:
    """word, other: for each term of the index whose stem others share, the commonest of these; ties to the first by code point.

    A word-form dimension that the collection gives by itself; tables from elsewhere take its place.
    """
    def build():
        forms = r.vocabulary.select("term", "df").join(r.stems, "term")
        order = Window.partitionBy("stem").orderBy(F.desc("df"), "term")
        first = forms.select("stem", "term", F.row_number().over(order).alias("n")).where(F.col("n") <= 2).groupBy("stem").agg(
            F.max(F.when(F.col("n") == 1, F.col("term"))).alias("one"), F.max(F.when(F.col("n") == 2, F.col("term"))).alias("two")).where("two is not null")
        return forms.join(first, "stem").select(F.col("term").alias("word"), F.when(F.col("term") == F.col("one"), F.col("two")).otherwise(F.col("one")).alias("other"))

    return r._table("stem_mates", build, "inputs")


def synonym_variants(queries: DataFrame, corpus_words: DataFrame, synonyms: DataFrame, irregular: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """query_id, variant_text: known words replaced, and one word's number changed if the corpus has the other form.

    `synonyms` (word, other) are lower-case; of several for a word the first by code point
    is taken. `irregular` (word, other) has number forms that the rules don't give, each
    way round in a row of its own. Both are joined, so Spark broadcasts them only where
    they are small.
    """
    one = lambda table, name: table.groupBy(F.col("word").alias("_lower")).agg(F.min("other").alias(name))
    rows = queries.select("query_id", F.posexplode(words(F.col("query_text"))).alias("i", "word"))
    rows = rows.withColumn("core", F.regexp_extract("word", r"^(.*?[\p{L}\p{N}])?([^\p{L}\p{N}]*)$", 1)).withColumn("tail", F.regexp_extract("word", r"^(.*?[\p{L}\p{N}])?([^\p{L}\p{N}]*)$", 2))
    rows = rows.withColumn("_lower", F.lower("core")).join(one(synonyms, "new"), "_lower", "left")
    rows = rows.withColumn("new", F.when(F.substring("core", 1, 1).rlike(r"\p{Lu}"), F.initcap("new")).otherwise(F.col("new"))).withColumn("w", F.col("core"))
    flip = F.when(F.col("w").endswith("s"), singular(F.col("w"))).otherwise(plural(F.col("w")))
    if irregular is not None:
        rows, flip = rows.join(one(irregular, "_irregular"), "_lower", "left"), F.coalesce("_irregular", flip)
    able = F.col("core").rlike(r"^\p{Ll}{4,}$") & ~F.col("core").isin(*CONTENT_STOPWORDS)
    flips = rows.where(able).withColumn("flip", flip).where("flip != core").join(corpus_words.select(F.col("term").alias("flip")), "flip", "left_semi")
    first = flips.groupBy("query_id").agg(F.min(F.struct(draw(seed, "flip", F.col("query_id"), F.col("i")).alias("h"), "i", "flip")).alias("f"))
    rows = rows.join(first, "query_id", "left").withColumn("out", F.when(F.col("i") == F.col("f.i"), F.col("f.flip")).otherwise(F.coalesce("new", "core")))
    parts = F.array_sort(F.collect_list(F.struct("i", F.concat("out", "tail").alias("w"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["w"]), " ").alias("variant_text"))


def corpus_words(r: Retrieval) -> DataFrame:
    return r._table("corpus_words", lambda: r.docs.select(F.explode("tokens").alias("term")).distinct(), "inputs")


def sampled(r: Retrieval, n: int | None = QUERIES, seed: int = SEED) -> DataFrame:
    """`n` of the queries, or all."""
    return r.queries if n is None else r.queries.orderBy(draw(seed, "stability", F.col("query_id")), "query_id").limit(n)


#: A rewrite: (queries, the corpus's words) to a table query_id, variant_text.
Rewrite = Callable[[DataFrame, DataFrame], DataFrame]


def rewrites(synonyms: DataFrame, irregular: DataFrame | None = None) -> dict[str, Rewrite]:
    """The usual rewrites by name, with these word forms."""
    return {
        "destop": lambda own, known: own.select("query_id", destopped(F.col("query_text")).alias("variant_text")),
        "shuffle": lambda own, known: own.select("query_id", shuffled(F.col("query_text"), F.col("query_id")).alias("variant_text")),
        "synonym": lambda own, known: synonym_variants(own, known, synonyms, irregular),
    }


def variants(r: Retrieval, made: dict[str, Rewrite] | None = None, n: int | None = QUERIES) -> DataFrame:
    """query_id, query_text, variant, variant_text of `n` queries or all; by default with the collection's own word forms."""
    own, known = sampled(r, n), corpus_words(r)
    given = rewrites(stem_mates(r)) if made is None else made
    rows = [rewrite(own, known).select("query_id", F.lit(name).alias("variant"), "variant_text") for name, rewrite in given.items()]
    return reduce(DataFrame.unionByName, rows).join(own, "query_id")


def rankings(r: Retrieval, texts: DataFrame, top: int = TOP) -> DataFrame:
    """text, config, docs: the first documents by each channel alone and by the whole pipeline."""
    texts = texts.select("text").distinct()
    lists = lambda rows, name, n: rows.groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct(n, "doc_id"))), lambda x: x["doc_id"]).alias("docs")).select("text", F.lit(name).alias("config"), "docs")
    worlds = texts.select(F.col("text").alias("world_id"), *(F.col("text").alias(f"{s}_text") for s in ("bm25", "dense", "rerank")), F.lit("union").alias("first_stage"))
    full = r.run(worlds).where(F.col("n") <= top).withColumnRenamed("world_id", "text")
    return lists(r.bm25_top(texts, top), "bm25", "rk").unionByName(lists(r.dense_top(texts, top), "dense", "rk")).unionByName(lists(full, "full", "n"))


def stability_raw(r: Retrieval, n: int | None = QUERIES) -> DataFrame:
    """A row for each of `n` queries, or of all, each variant and configuration with the overlap of both rankings."""
    end = {QUERIES: "", None: "_all"}.get(n, f"_{n}")

    def build():
        rows = r._table(f"variants{end}", lambda: variants(r, n=n))
        found = r._table(f"rankings{end}", lambda: rankings(r, rows.select(F.col("query_text").alias("text")).unionByName(rows.select(F.col("variant_text").alias("text")))))
        before, after = found.select(F.col("text").alias("query_text"), "config", F.col("docs").alias("a")), found.select(F.col("text").alias("variant_text"), "config", F.col("docs").alias("b"))
        both = rows.join(before, "query_text").join(after, ["variant_text", "config"])
        return both.select("query_id", "variant", "config", F.round(rbo(F.col("a"), F.col("b")), 9).alias("rbo"), (F.col("a") == F.col("b")).alias("identical"),
                           F.col("query_text").alias("query_original"), F.col("variant_text").alias("query_variant"), (F.col("query_text") == F.col("variant_text")).alias("unchanged_text"))

    return r._table(f"stability{end}", build)


def stability_noop(raw: DataFrame) -> DataFrame:
    share = F.avg(F.col("unchanged_text").cast("double"))
    return raw.groupBy("variant").agg(F.round(share, 9).alias("frac_noop"), (share >= DEGENERATE).alias("degenerate"))


def stability_summary(raw: DataFrame) -> DataFrame:
    """Per variant and configuration; columns over changed texts are null where nothing changed."""
    value, changed = F.col("rbo").cast("decimal(38,12)"), ~F.col("unchanged_text")
    mean = lambda c: F.avg(c).cast("double")
    rows = raw.groupBy("variant", "config").agg(
        F.round(mean(value), 9).alias("mean_rbo"), F.round(F.stddev_samp("rbo"), 6).alias("std_rbo"), F.min("rbo").alias("min_rbo"), F.round(F.avg(F.col("identical").cast("double")), 9).alias("frac_identical"),
        F.count(F.lit(1)).alias("n"), F.round(mean(F.when(changed, value)), 9).alias("mean_rbo_changed"), F.nullif(F.count_if(changed), F.lit(0)).alias("n_changed"))
    rows = rows.withColumn("instability", F.round(1 - F.col("mean_rbo"), 9)).withColumn("instability_changed", F.round(1 - F.col("mean_rbo_changed"), 9))
    return rows.join(stability_noop(raw), "variant")


def rbo_box_stats(raw: DataFrame) -> DataFrame:
    found = quantiles(raw, ["variant", "config"], "rbo", (0.0, 0.25, 0.5, 0.75, 1.0))
    return found.select("variant", "config", *(F.round(F.col("q")[i], 9).alias(name) for i, name in enumerate(("lowest", "q1", "median", "q3", "highest"))))


def least_stable(raw: DataFrame) -> DataFrame:
    """query_id, variant, config, rbo of the ranking that a rewrite changed most; ties to the first by variant, config and id."""
    key = F.struct("rbo", "variant", "config", "query_id")
    return raw.agg(F.min(key).alias("x")).where("x is not null").select("x.query_id", "x.variant", "x.config", "x.rbo")
