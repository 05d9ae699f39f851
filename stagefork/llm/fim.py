"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and put together in another order.

A text becomes a numpy array of its code points. A class for each code point, compared
with its neighbour's, says where a unit begins; two units' ends, chosen by the hash of
the row's key, are the cuts. Rows don't meet, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import free_name, slices, table

NEWLINE = 10
#: Classes of ASCII code points when units are runs: letters and `_`, digits, white space, others; code points beyond ASCII count as letters.
_RUNS = np.array([2 if c in b" \t\n\x0b\x0c\r" else 1 if chr(c).isdigit() else 0 if chr(c).isalpha() or c == 95 else 3 for c in range(128)], np.uint8)
#: SQL of op13_fill_in_middle.
OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS hex,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents),
h AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || substr(hex, 1, 8))::BIGINT AS h1, ('0x' || substr(hex, 9, 8))::BIGINT AS h2,
         ('0x' || substr(hex, 17, 8))::BIGINT AS h3, ('0x' || substr(hex, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                               WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
         array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
         array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix FROM h)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM c
"""


@dataclass(frozen=True)
class Cut:
    """How texts are cut. `rate` percent of them are, `suffix_first` percent of those with the suffix in front.

    Marks must be three different strings that begin with a character which occurs in
    none of them again, so that no mark can begin inside another or across a seam.
    """

    unit: str = "line"
    rate: int = 100
    suffix_first: int = 50
    seed: int = 7
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def __post_init__(self):
        if self.unit not in ("line", "run"):
            raise ValueError("units are lines or runs")
        if len(set(self.marks)) < 3 or any(len(m) < 2 or o.rfind(m[0]) > 0 for m in self.marks for o in self.marks):
            raise ValueError("marks must differ, and their first characters must occur at no other place")


def starts(points: np.ndarray, unit: str = "line") -> np.ndarray:
    """Places where units begin, and the end behind them: lines with their newline, or runs of one class."""
    if not len(points):
        return np.zeros(1, np.int64)
    if unit == "line":
        begins = points[:-1] == NEWLINE
    else:
        kinds = _RUNS[np.minimum(points, 127)]
        kinds[points > 127] = 0
        begins = kinds[1:] != kinds[:-1]
    return np.concatenate(([0], np.flatnonzero(begins) + 1, [len(points)]))


def draws(key: str, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the sha256 of seed and key."""
    hexed = hashlib.sha256(f"{seed}:{key}".encode("utf-8", "surrogatepass")).hexdigest()
    return tuple(int(hexed[i : i + 8], 16) for i in range(0, 32, 8))


def rearranged(text: str, key: str, how: Cut) -> tuple[str, int, str, int | None, int | None]:
    """Output, number of units, form, and code points of prefix and middle (None where the form is plain)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    bounds = starts(points, how.unit)
    n = len(bounds) - 1
    a, b, chosen, order = draws(key, how.seed)
    if not text or any(m in text for m in how.marks) or chosen % 100 >= how.rate:
        return text, n, "plain", None, None
    first, second = sorted((a % (n + 1), b % (n + 1)))
    to, behind = int(bounds[first]), int(bounds[second])
    prefix, middle, suffix = (points[x:y].tobytes().decode("utf-32-le", "surrogatepass") for x, y in ((0, to), (to, behind), (behind, len(points))))
    p, s, m = how.marks
    if order % 100 < how.suffix_first:
        return f"{s}{suffix}{p}{prefix}{m}{middle}", n, "spm", to, behind - to
    return f"{p}{prefix}{s}{suffix}{m}{middle}", n, "psm", to, behind - to


def put_back(output: str, form: str, marks: tuple[str, str, str]) -> str:
    """The text behind an output; a mark's first occurrence is the mark."""
    if form == "plain":
        return output
    p, s, m = marks
    one, two = (p, s) if form == "psm" else (s, p)
    if not output.startswith(one):
        raise ValueError("the output doesn't begin with its mark")
    head, _, rest = output[len(one) :].partition(two)
    body, _, middle = rest.partition(m)
    return head + middle + body if form == "psm" else body + middle + head


def fill_in_middle(docs: DataFrame, how: Cut = Cut(), id_col: str = "doc_id", text_col: str = "text", out_col: str = "output") -> DataFrame:
    """The rows of `docs` with a struct `out_col`: text (the output), n (units), form (plain, psm or spm), prefix_chars, middle_chars.

    A null text is cut as an empty one, which is plain with n = 0; a null
    id counts as empty text; rows that repeat an id are cut alike if their texts are
    equal; columns with other names stay as they are, and one named `out_col` raises.
    """
    if out_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"{out_col} is a column already")
    columns = docs.columns
    key, text = free_name(docs, "_key"), free_name(docs, "_text")
    given = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(key), F.coalesce(text_col, F.lit("")).alias(text), *columns)
    fields = [pa.field("text", pa.string()), pa.field("n", pa.int64()), pa.field("form", pa.string()), pa.field("prefix_chars", pa.int64()), pa.field("middle_chars", pa.int64())]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            made = [rearranged(t, k, how) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            struct = pa.StructArray.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(fields)], fields=fields)
            yield pa.RecordBatch.from_arrays([*part.columns[2:], struct], names=[*columns, out_col])

    schema = T.StructType([*docs.schema, T.StructField(out_col, T.StructType.fromDDL("text string, n bigint, form string, prefix_chars bigint, middle_chars bigint"))])
    return given.mapInArrow(of, schema)


def restored(outputs: DataFrame, how: Cut = Cut(), out_col: str = "output", to: str = "restored") -> DataFrame:
    """`outputs` with the texts rebuilt from `out_col`'s text and form alone; null outputs give null."""
    columns, schema = outputs.columns, T.StructType([*outputs.schema, T.StructField(to, T.StringType())])
    text, form = free_name(outputs, "_text"), free_name(outputs, "_form")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            back = [None if t is None else put_back(t, f, how.marks) for t, f in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[2:], pa.array(back, pa.string())], names=[*columns, to])

    return outputs.select(F.col(f"{out_col}.text").alias(text), F.col(f"{out_col}.form").alias(form), *columns).mapInArrow(of, schema)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's output and of the text rebuilt from it."""
    cut = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "output")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return restored(cut).select("doc_id", "output.n", "output.form", "output.prefix_chars", "output.middle_chars",
                                sha("output.text").alias("output_sha256"), sha("restored").alias("restored_sha256"))
