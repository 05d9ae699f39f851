"""Artefacts of a run: sharded tables, their merge, summaries as CSV, a manifest, a report."""

from __future__ import annotations

import json

import pyspark
from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import code_fingerprint, exists, file_system, numbered


def shard_of(queries: DataFrame, shards: int) -> DataFrame:
    """query_id, shard: ids in order, dealt out in turn."""
    return numbered(queries.select("query_id"), "query_id").select("query_id", F.pmod("number", F.lit(shards)).cast("int").alias("shard"))


def write_shards(table: DataFrame, queries: DataFrame, path: str, shards: int) -> None:
    """`table` (with query_id) as Parquet, a folder for each shard; shards that are there already are written anew, others stay."""
    dealt = table.join(shard_of(queries, shards), "query_id").repartition("shard", "query_id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def write_shard(rows: DataFrame, path: str, shard: int) -> None:
    """One shard's rows; a second writing takes the first one's place and leaves other shards alone."""
    rows.withColumn("shard", F.lit(shard)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def merge_shards(spark: SparkSession, path: str, shards: int, queries: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """The table behind the shards, with their numbers if `keep`; an error if a shard is missing.

    Given `queries`, only the shards that they are dealt to must be there.
    """
    wanted = range(shards) if queries is None else sorted(r["shard"] for r in shard_of(queries, shards).select("shard").distinct().collect())
    if missing := [s for s in wanted if not exists(spark, f"{path}/shard={s}")]:
        raise ValueError(f"shards {missing} are missing in {path}")
    rows = spark.read.parquet(path).where(F.col("shard") < shards)
    return rows if keep else rows.drop("shard")


def write_csv(table: DataFrame, path: str) -> None:
    """A small summary as one CSV file with a header."""
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small value (metrics, timings, run metadata) as one JSON file in the folder `path`."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The value behind `write_json`; None if there is none."""
    if not exists(spark, path):
        return None
    row = spark.read.text(path).first()
    return json.loads(row["value"]) if row else None


def remove(spark: SparkSession, path: str) -> None:
    fs, where = file_system(spark, path)
    fs.delete(where, True)


def run_meta(settings: dict) -> dict:
    """What a run's artefacts hang on: the caller's settings, the code and Spark's version."""
    return {"settings": settings, "code": code_fingerprint(), "spark": pyspark.__version__}


def stale(spark: SparkSession, path: str, meta: dict) -> list[str]:
    """The keys in which the metadata written at `path` differs from `meta`; all of them if none was written."""
    found = read_json(spark, path) or {}
    meta = json.loads(json.dumps(meta))
    return sorted(k for k in meta.keys() | found.keys() if k not in found or k not in meta or found[k] != meta[k])


def load_artifacts(spark: SparkSession, folder: str, names: tuple[str, ...]) -> dict[str, DataFrame | None]:
    """Parquet tables below `folder` by name; None for those that aren't there."""
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in names}
    return {name: spark.read.parquet(path) if exists(spark, path) else None for name, path in paths.items()}


def shard_rows(table: DataFrame, queries: DataFrame, shard: int, shards: int) -> DataFrame:
    """Rows of `table` (with query_id) whose query is dealt to `shard`."""
    own = shard_of(queries, shards).where(F.col("shard") == shard).select("query_id")
    return table.join(own, "query_id", "left_semi")


def manifest(spark: SparkSession, path: str, meta: dict | None = None) -> DataFrame:
    """path, bytes and the start of the SHA-256 of every file below `path`; behind them a row `meta:<key>` with the JSON of each value of `meta`.

    Spark hands each file to a task whole, so files beyond 2 GB can't be digested.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    out = files.select("path", F.col("length").alias("bytes"), F.substring(F.sha2("content", 256), 1, 16).alias("sha256"))
    values = [(f"meta:{k}", None, json.dumps(v, sort_keys=True)) for k, v in sorted((meta or {}).items())]
    return out.unionByName(spark.createDataFrame(values, "path string, bytes long, sha256 string")) if values else out


def markdown_table(table: DataFrame, digits: int = 4) -> str:
    """A small table as Markdown; floats are rounded, booleans read YES or no."""
    def shown(x) -> str:
        return "" if x is None else "YES" if x is True else "no" if x is False else f"{x:.{digits}f}" if isinstance(x, float) else str(x)

    head = "| " + " | ".join(table.columns) + " |\n|" + "---|" * len(table.columns) + "\n"
    return head + "".join("| " + " | ".join(map(shown, row)) + " |\n" for row in table.collect())


#: Sections of a report: artefact, heading and what the table says.
SECTIONS = (
    ("ndcg", "Baseline", "Mean gain of each channel alone and of the whole pipeline."),
    ("arm_means", "Interventions", "Mean changes of a target's rank and scores where a term is put into its query: terms of the target against matched controls, which the lexical score must not see."),
    ("contrast", "Contrast of the arms", "Absolute change of rank, treatment less control, with the ends of a 95 % interval; queries are drawn whole."),
    ("design", "Design checks", "The largest change of a control's lexical score, which must be 0, and the share of targets whose rank was censored before."),
    ("mediation_ratio", "Paths", "Mean size of each path's effect and its share, by freezing stages at the query before."),
    ("stability", "Stability", "Overlap of rankings before and after rewrites; a rewrite that leaves most queries alone is degenerate."),
    ("effects", "Effects of concepts", "Naive against orthogonalised estimates; a naive one outside the interval is confounded."),
)


def limitations(found: dict[str, DataFrame | None]) -> list[str]:
    """What the artefacts themselves say against their reading."""
    out = [f"No artefact `{name}`; its section is empty." for name, *_ in SECTIONS if found.get(name) is None]
    one = lambda name: found[name].first() if found.get(name) is not None else None
    if (row := one("ndcg")) and row["full_pipeline"] is not None and not row["reranker_helps"]:
        out.append("The whole pipeline gains no more than its better channel, so paths through the reranker say little.")
    if (row := one("contrast")) and (row["n_clusters"] or 0) < 30:
        out.append(f"The interval rests on {row['n_clusters'] or 0} queries; percentiles of so few are rough.")
    if row := one("design"):
        if row["max_abs_delta_bm25_control"]:
            out.append(f"A control term changed a lexical score by {row['max_abs_delta_bm25_control']}: controls leak.")
        if row["censored_share"]:
            out.append(f"Of the targets, {100 * row['censored_share']:.1f} % had a censored rank, whose changes are lower bounds.")
    if found.get("stability") is not None:
        names = sorted(r["variant"] for r in found["stability"].where("degenerate").select("variant").distinct().collect())
        out += [f"The rewrite {name} left most queries as they were." for name in names]
    if found.get("effects") is not None and found["effects"].isEmpty():
        out.append("No concept could be estimated.")
    return out


def report(found: dict[str, DataFrame | None], verdict: str | None = None, meta: dict | None = None) -> str:
    """Markdown: the run, the verdict, a section for each summary that is there, and limitations. Summaries are a few rows each."""
    lines = ["# Report", ""]
    if meta:
        lines += [f"Code {meta['code']}, inputs {meta.get('inputs', 'unknown')}, Spark {meta['spark']}, settings {json.dumps(meta['settings'], sort_keys=True)}.", ""]
    lines += ["## Verdict", "", verdict or "Not judged: the criteria are missing.", ""]
    for name, heading, says in SECTIONS:
        lines += [f"## {heading}", "", says, "", markdown_table(found[name]) if found.get(name) is not None else "Not run.\n"]
    against = limitations(found)
    return "\n".join([*lines, "## Limitations", "", *(f"- {x}" for x in against or ["None found in the artefacts."])]) + "\n"
