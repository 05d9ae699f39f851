"""The collection: documents, queries and judgements as tables.

Documents have no title of their own; the first line stands for it. A benchmark item
is a query by its four most common terms that are neither rare nor everywhere, and a
document that holds the whole item is relevant to it, more so if labelled good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import CONTENT_STOPWORDS, INDEX_STOPWORDS, tokenize, without
from .store import scratch

#: Share of documents that a query term is in; terms of a query.
BAND, TERMS = (0.05, 0.40), 4
#: Words of an item by whose hash documents are found.
KEY_WORDS = 4


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Words of a document that a reranker reads.
CE_WORDS = 460


def _texts(text: Column, ce_words: int = CE_WORDS) -> list[Column]:
    """title, text, ce_text of a text that isn't null."""
    words = F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, ce_words), " ")
    return [F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"), text.alias("text"), words.alias("ce_text")]


def tokenised(spark: SparkSession, sf_dir: str, ce_words: int = CE_WORDS) -> DataFrame:
    """doc_id, title, text, ce_text, tokens: the table in which each text is tokenised once."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return docs.select("doc_id", *_texts(F.col("text"), ce_words), tokenize(F.col("text")).alias("tokens"))


def words_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """A word list (stop words, a lexicon) from a text file with a word a line; case and blank lines don't count. Lists are short."""
    word = F.lower(F.trim("value"))
    return tuple(sorted(r["w"] for r in spark.read.text(path).select(word.alias("w")).where("w != ''").distinct().collect()))


def corpus(tokens: DataFrame, stopwords: tuple[str, ...] = CONTENT_STOPWORDS) -> DataFrame:
    """doc_id, title, text, ce_text, tokens, content_tokens, doc_len from `tokenised`; `stopwords` are left out of content tokens."""
    indexed = F.size(without(F.col("tokens"), INDEX_STOPWORDS)).cast("double")
    return tokens.select("*", without(F.col("tokens"), stopwords).alias("content_tokens"), indexed.alias("doc_len"))


def described(kept: DataFrame, stopwords: tuple[str, ...] = CONTENT_STOPWORDS) -> DataFrame:
    """What `corpus` makes of tokens, from its doc_id, tokens and doc_len."""
    return kept.select("doc_id", "tokens", without(F.col("tokens"), stopwords).alias("content_tokens"), "doc_len")


def fold_judgements(rows: DataFrame, order: str = "place") -> DataFrame:
    """query_id, doc_id, rel of given judgements: of those that repeat a pair, the last by `order` holds; a null relevance is no judgement."""
    return rows.where(F.col("rel").isNotNull()).groupBy("query_id", "doc_id").agg(F.max_by(F.col("rel").cast("int"), order).alias("rel"))


def holding(docs: DataFrame, items: DataFrame, key_words: int = KEY_WORDS) -> DataFrame:
    """query_id, doc_id of documents (doc_id, text) that hold a whole item (query_id, item), wherever it begins.

    An item's words but for the first and last must stand in the document as they are,
    so the hash of its first such words is looked up among the document's windows of as
    many words, and a match is verified by the texts. An item without inner words is
    looked up among the document's parts of its own length. Null texts hold nothing, an
    empty item is held by all others.
    """
    inner = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 2, F.lit(0)))
    keyed = items.where("item is not null").select("query_id", "item", inner(F.split("item", r"\s+")).alias("words"))
    keyed = keyed.select("query_id", "item", F.least(F.size("words"), F.lit(key_words)).alias("k"), "words")
    long = keyed.where("k > 0").select("query_id", "item", "k", F.xxhash64("k", F.slice("words", 1, F.col("k"))).alias("key"))
    short = keyed.where("k = 0").select("query_id", "item", F.length("item").alias("size"))
    texts = docs.where("text is not null").select("doc_id", "text")
    # A handful of numbers: the lengths of keys and of short items that occur.
    ks = long.agg(F.collect_set("k").alias("ks"))
    sizes = short.agg(F.collect_set("size").alias("sizes"))
    windows = texts.select("doc_id", F.split("text", r"\s+").alias("words")).join(F.broadcast(ks)).select("doc_id", "words", F.explode("ks").alias("k")).where(F.size("words") >= F.col("k"))
    places = F.sequence(F.lit(1), F.size("words") - F.col("k") + 1)
    hashed = windows.select("doc_id", F.explode(F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.col("k"), F.slice("words", i, F.col("k")))))).alias("key"))
    # Written, so that its size is known and texts aren't dealt out for it.
    near = scratch(hashed.join(long.select("query_id", "key"), "key").select("query_id", "doc_id").distinct(), "near")
    by_words = texts.join(near, "doc_id").join(long.select("query_id", "item"), "query_id").where(F.contains("text", "item"))
    cut = texts.join(F.broadcast(sizes)).select("doc_id", "text", F.explode("sizes").alias("size")).where(F.length("text") >= F.col("size"))
    parts = cut.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - F.col("size") + 1), lambda i: F.substring(F.col("text"), i, F.col("size")))).alias("item"))
    by_length = parts.join(short.select("query_id", "item"), "item")
    return by_words.select("query_id", "doc_id").unionByName(by_length.select("query_id", "doc_id")).distinct()


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, doc_id, rel: a document that holds an item is relevant to it, more so if labelled good."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    found = holding(read(spark, sf_dir, "documents"), items)
    marks = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return found.join(marks, "doc_id", "left").select("query_id", "doc_id", (1 + F.coalesce("quality", F.lit(0))).cast("int").alias("rel"))


def queries(spark: SparkSession, sf_dir: str, vocabulary: DataFrame, qrels: DataFrame, n_docs: int) -> DataFrame:
    """query_id, query_text of items with a judged document; `vocabulary` has term and df."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(without(tokenize(F.col("text")), INDEX_STOPWORDS))).alias("term"))
    band = vocabulary.where(F.col("df").between(BAND[0] * n_docs, BAND[1] * n_docs)).select("term", "df")
    order = Window.partitionBy("query_id").orderBy(F.desc("df"), "term")
    best = items.join(band, "term").withColumn("n", F.row_number().over(order)).where(F.col("n") <= TERMS)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]), " ")
    return best.join(qrels.select("query_id").distinct(), "query_id", "left_semi").groupBy("query_id").agg(text.alias("query_text"))
