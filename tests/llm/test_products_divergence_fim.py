"""Operators 11 to 13: against their SQL, against plain loops over odd rows, and their parts alone."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from stagefork.llm import divergence as D, fim, queries, top_products as T

MORE = "/root/testdata/sf0.01"
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", ["op11_top_products", "op12_divergence", "op13_fill_in_middle"])
def test_equal_sql(spark, name):
    for table in ("documents", "embeddings"):
        duckdb.sql(f"create or replace view {table} as select * from '{MORE}/{table}.parquet'")
    got = queries.QUERIES[name](spark, MORE)
    want = Counter(duckdb.sql(f"select {', '.join(got.columns)} from ({queries.SQL[name]})").fetchall())
    assert Counter(map(tuple, got.collect())) == want and want


def floored(x):
    return int(x) * 256 if abs(x) >= 2**45 else math.floor(x * 256)


def plain_products(table, every, k):
    ok = [(v, [floored(x) for x in e]) for v, e in table if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = Counter()
    for q, x in {(v, tuple(e)) for v, e in ok if v is not None and v % every == 0}:
        found = sorted(((-sum(a * b for a, b in zip(x, y)), v is None, v or 0) for v, y in ok if v != q))[:k]
        out.update((q, i + 1, None if null else v, min(max(-s, T.LOW), T.HIGH)) for i, (s, null, v) in enumerate(found))
    return out


@pytest.mark.parametrize("block, cosine", [(4, 0.0), (16, 0.8), (2048, 2.0)])
def test_top_products_by_plain_loops(spark, monkeypatch, block, cosine):
    """Skewed lengths, copies and ties, zero, empty and short vectors, null and repeated ids, components from 1e-300 to 1e300; small blocks let bounds decide."""
    monkeypatch.setattr(T, "BLOCK", block)
    monkeypatch.setattr(T, "PACK", 8)
    monkeypatch.setattr(T, "COSINE", cosine)
    rng = np.random.default_rng(block)
    centres = rng.standard_normal((5, 6))
    table = [(i, (float(rng.lognormal(0, 1.5)) * (centres[i % 5] + 0.2 * rng.standard_normal(6))).tolist()) for i in range(300)]
    table += [(1000 + i, table[3][1]) for i in range(40)] + [(1100, table[3][1]), (1100, table[3][1]), (1150, [0.0] * 6), (1150, [1.0] * 6), (1200, []), (1250, [1.0]), (None, table[3][1]), (None, None)]
    table += [(1301, None), (1350, [None, 1.0]), (1400, [math.nan, 1.0]), (1450, [-math.inf]), (1500, [1e-300] * 6), (1550, [-1e-300, 0.001])]
    table += [(1600, [1e300, -1e300, 1.0]), (1601, [1e20] * 6), (1650, [-1e20, 1e19]), (1602, [3e7] * 6), (1700, [3e7, 5.0])]
    made = spark.createDataFrame(table, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as pack")
    assert Counter(map(tuple, T.top_products(made, 50, 5).collect())) == plain_products(table, 50, 5)


def test_coordinates_lose_no_candidate():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 8)) + np.eye(8)[rng.integers(0, 8, 500)] * 4
    size = T.lengths(x)
    order = np.argsort(-size)
    block = T.Block({"ids": np.arange(500).tobytes(), "nulls": np.zeros(63, np.uint8).tobytes(), "cells": x[order].tobytes(), "width": 8, "length": size.max()})
    unit = x[order] / np.linalg.norm(x[order], axis=1)[:, None]
    left = []
    for d in unit[::25]:
        for cosine in (0.0, 0.5, 0.8, 0.95, 1.0):
            places = T.by_coordinates(block, d, cosine)
            assert set(np.flatnonzero(unit @ d >= cosine)) <= set(places.tolist())
            left.append(len(places) / 500 if cosine == 0.95 else 1)
    assert min(left) < 0.3


def test_few_vectors_and_no_queries(spark):
    made = spark.createDataFrame([(50, [1.0]), (51, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in T.top_products(made).collect()] == [(50, 1, 51, 256 * 512)]
    assert T.top_products(made.where("vec_id = 51")).count() == 0


def plain_divergence(docs, least, ranks):
    groups, counts, seen = set(), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = Counter(re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or ""))
        counts[lang, source] += terms
        seen[lang].update(terms.keys())
    out = Counter()
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= least]
        v, whole = len(kept), Counter()
        sources = [s for x, s in groups if x == lang]
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c):
            size = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (size + v) for t in kept}

        p, q = shares(counts[lang, source]), shares(whole)
        gap = lambda a, b: (a - b) ** 2 // b
        pairs = [(-sum(gap(p[t], o[t]) for t in kept), s.encode(), s) for s in sources if s != source for o in [shares(counts[lang, s])]]
        terms = [(-gap(p[t], q[t]), t.encode(), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:ranks])):
            out.update((lang, source, part, item, -value, i + 1) for i, (value, _, item) in enumerate(found))
    return out


@pytest.mark.parametrize("pairs", [3, 1 << 20])
def test_divergence_by_plain_loops(spark, monkeypatch, pairs):
    """Groups without terms, a language that keeps none, nulls, ties, other scripts, one hot source, and lists that are cut."""
    monkeypatch.setattr(D, "PAIRS", pairs)
    monkeypatch.setattr(D, "ENTRIES", 5)
    docs = [("Alpha beta ALPHA été É", "a", f"s{i % 5}") for i in range(20)] + [("beta gamma" * (i % 3) + " ß日本 x1y_z", "a", "hot") for i in range(30)]
    docs += [(None, "a", "none"), ("", "a", None), ("... 123", "a", "\U0001F600"), ("once only", "b", "s1"), ("never again", "b", "s2"), ("alone " * 3, None, None), ("alone", None, None), ("alone x y", None, None)]
    docs += [(f"t{i} t{chr(97 + i % 26)} alpha", "a", "～") for i in range(40)]
    made = spark.createDataFrame(docs, "text string, lang string, source string").selectExpr("*", "1 as term", "2 as n", "3 as postings")
    assert Counter(map(tuple, D.source_divergence(made, ranks=4).collect())) == plain_divergence(docs, 3, 4)


def test_shares_stay_exact_beyond_64_bits(spark):
    """Counts for which 10^9 (count + 1) leaves a long."""
    from pyspark.sql import functions as F

    n, size, v = 10**13 + 7, 3 * 10**13, 12345
    row = spark.range(1).select(D.share(F.lit(n), F.lit(size), F.lit(v)).alias("p"), D.gap(F.lit(10**9).cast("long"), F.lit(1).cast("long")).alias("f")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (size + v) and row.f == (10**9 - 1) ** 2


ODD = [None, "", "\n", "\n\n", "a", "a\n", "a\nb", "\r\nx\n y", "é日本\U0001F600\n" * 5, "has <P> in it\nx", "<S>", "x<M", "<", "<P\n>", "<<\n<\n<", "M>\nS>\nP>"]


def plain_cut(text, key, how):
    text = text or ""
    units = re.findall("[^\n]*\n|[^\n]+", text)
    n, hexed = len(units), hashlib.sha256(f"{how.seed}:{key}".encode()).hexdigest()
    h = [int(hexed[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in how.marks) or h[2] % 100 >= how.rate:
        return text, n, "plain", None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < how.suffix_first else f"<P>{p}<S>{s}<M>{m}"
    return out, n, "spm" if h[3] % 100 < how.suffix_first else "psm", len(p), len(m)


@pytest.mark.parametrize("how", [fim.Cut(), fim.Cut(rate=40, suffix_first=90, seed=3)])
def test_fill_in_middle_of_odd_texts(spark, how):
    """Outputs by plain loops, and texts rebuilt from output and form; null and repeated ids, a text of two million characters, clashing names."""
    long = "ab\ncd日 " * 300_000
    table = [(i, t) for i, t in enumerate(ODD * 6)] + [(None, "x\ny"), (None, "x\ny"), (7, "other\n"), (5000, long)]
    made = spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "1 as n", "2 as form", "3 as _text")
    got = fim.restored(fim.fill_in_middle(made, how), how).collect()
    want = Counter((i, t, *plain_cut(t, "" if i is None else i, how), t or "") for i, t in table)
    assert Counter((r["doc_id"], r["text"], *r["output"], r["restored"]) for r in got) == want
    assert all((r["n"], r["form"], r["_text"]) == (1, 2, 3) for r in got)
    assert len({w[4] for w in want}) == 3


def test_units_are_lines_or_runs():
    points = lambda t: np.frombuffer(t.encode("utf-32-le"), "<u4")
    cut = lambda t, unit: [t[a:b] for b0 in [fim.starts(points(t), unit)] for a, b in zip(b0, b0[1:])]
    assert cut("ab12 é_x\n\n!?", "run") == ["ab", "12", " ", "é_x", "\n\n", "!?"]
    assert cut("a\n\nb", "line") == ["a\n", "\n", "b"] and cut("", "run") == [] and cut("", "line") == []
    for text in ("ab12 é_x", "x"):
        out, n, form, *_ = fim.rearranged(text, "1", fim.Cut(unit="run"))
        assert fim.put_back(out, form, fim.Cut().marks) == text and n == len(cut(text, "run"))


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("<P>", "<<", "<M>"), ("P", "S", "M")])
def test_marks_that_could_be_mistaken_are_refused(marks):
    with pytest.raises(ValueError):
        fim.Cut(marks=marks)
