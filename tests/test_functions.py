import pytest
from pyspark.sql import functions as F

from stagefork.functions.ranking import rbo
from stagefork.functions.text import bigrams, content_tokens, jaccard, tokenize
from stagefork.operators.stability import destopped, shuffled


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(*items):
    return F.array(*map(F.lit, items)).cast("array<string>")


@pytest.mark.parametrize("text, want", [("Café, a b_2 x!", ["café", "b_2"]), ("", []), (None, []), ("日本 tok", ["日本", "tok"])])
def test_tokenize(spark, text, want):
    assert one(spark, tokenize(F.lit(text).cast("string"))) == want


def test_content_tokens_keep_repeats(spark):
    assert one(spark, content_tokens(F.lit("the cat and the cat"))) == ["cat", "cat"]


def test_bigrams(spark):
    assert one(spark, bigrams(array("a", "b", "c"))) == ["a b", "b c"]
    assert one(spark, bigrams(array("a"))) == []


def test_jaccard(spark):
    assert one(spark, jaccard(array(), array())) == 0.0
    assert one(spark, jaccard(array("a", "b"), array("b", "c"))) == pytest.approx(1 / 3)


def ranks(spark, a, b):
    return one(spark, rbo(F.array(*map(F.lit, a)).cast("array<int>"), F.array(*map(F.lit, b)).cast("array<int>")))


def test_rbo(spark):
    ten = list(range(10))
    assert ranks(spark, ten, ten) == pytest.approx(1.0)
    assert ranks(spark, ten, [x + 100 for x in ten]) == pytest.approx(0.0)
    swapped = ranks(spark, ten, [1, 0, *ten[2:]])
    assert swapped == pytest.approx(0.9)
    assert ranks(spark, ten, ten[::-1]) < swapped
    assert ranks(spark, [], []) == 1.0 and ranks(spark, [1], []) == 0.0
    assert ranks(spark, [1, 2, 3], [1, 2, 3, 4, 5]) == pytest.approx(ranks(spark, [1, 2, 3, 4, 5], [1, 2, 3]))


def test_rewrites(spark):
    assert one(spark, destopped(F.lit("the of"))) == "the of"
    assert one(spark, destopped(F.lit("the Heart."))) == "Heart."
    assert one(spark, shuffled(F.lit("ecmo"), F.lit(1))) == "ecmo"
    assert one(spark, shuffled(F.lit("a a"), F.lit(1))) == "a a"
    assert sorted(one(spark, shuffled(F.lit("a b c d"), F.lit(1))).split()) == ["a", "b", "c", "d"]
