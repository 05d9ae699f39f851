"""Tokens, terms and draws as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The English stop words of the index.
INDEX_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on",
    "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
#: Words left out of covariates and of sampled terms; a parameter, by default the index's and common function words.
CONTENT_STOPWORDS = INDEX_STOPWORDS + (
    "about", "after", "all", "also", "am", "any", "because", "been", "before", "being", "between", "both", "can", "could", "did",
    "do", "does", "down", "during", "each", "few", "from", "further", "had", "has", "have", "he", "her", "here", "him", "his",
    "how", "its", "may", "me", "more", "most", "my", "nor", "only", "other", "our", "out", "over", "own", "same", "she", "should",
    "so", "some", "than", "them", "through", "too", "under", "until", "up", "very", "we", "were", "what", "when", "where",
    "which", "while", "who", "whom", "why", "would", "you", "your",
)
WORD = r"^\p{L}{3,}$"


def tokenize(text: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def without(tokens: Column, stopwords=CONTENT_STOPWORDS) -> Column:
    """Tokens that aren't stop words, in order and with repeats."""
    return F.filter(tokens, lambda t: ~t.isin(*stopwords)) if stopwords else tokens


def index_terms(text: Column) -> Column:
    return without(tokenize(text), INDEX_STOPWORDS)


def content_tokens(text: Column) -> Column:
    return without(tokenize(text), CONTENT_STOPWORDS)


def bigrams(tokens: Column) -> Column:
    """Neighbouring tokens, joined by a space."""
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(tokens) > 1, pairs).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token lists as sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def draw(*parts) -> Column:
    """A number from 0 to 2**32 - 1 that hangs on the parts alone; both engines compute the same."""
    named = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    return (draw(*parts) + 0.5) / float(1 << 32)
