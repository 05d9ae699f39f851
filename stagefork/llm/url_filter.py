"""URL filters: fixed rules, and purity over a tree of path templates.

Every host has a tree of path segments, as deep as its paths but for a bound. At each step a segment
stays literal if it stands for many pages of its parent, or if its labelled pages are
bad far more or less often than the parent's; all others are one variable segment,
written `*`, of which numbers are told apart as `#`. Literal branches of one parent whose
labelled shares don't differ significantly are merged. Each template then has a
purity: the share of its labelled pages with a bad label, smoothed towards its
parent's. Pages of templates above a limit are blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import ascii_lower, saved, table

#: Rules of the query, as host and path: the longest that fits decides.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Steps of the tree: a bound of its plan. No usual path is as deep; what follows is one variable tail.
DEPTH = 32
#: A literal segment has at least so many pages and a share of its parent's, or at least so many labelled pages and a share of bad ones so many standard errors from the parent's.
LEAST_PAGES, LEAST_SHARE, LEAST_LABELS, CLEAR = 20, 0.05, 5, 3.0
#: Weight of the parent's purity in labelled pages; difference in standard errors from which branches stay apart; purity that blocks.
PRIOR, APART, LIMIT = 20.0, 1.96, 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Empty for a null url and one without `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    which = verdict = F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        which = F.when(fits, name + start).otherwise(which)
        verdict = F.when(fits, says).otherwise(verdict)
    return which, verdict


def _segments(path: Column) -> Column:
    """Segments of a path without its leading slash; file endings stay, numbers in them don't matter."""
    return F.split(F.regexp_replace(path, "^/", ""), "/")


def _variable(segment: Column) -> Column:
    return F.when(segment.rlike(r"^[0-9]+(\.[a-z]+)?$"), "#").otherwise("*")


def path_templates(pages: DataFrame) -> DataFrame:
    """host, path, template, with `way`: the merged names on the way, one a step.

    `pages` has host, path, n (rows), labelled and bad (of them), each host and path once.
    """
    rows = pages.withColumn("segments", _segments(F.col("path"))).withColumn("branch", F.lit("")).withColumn("way", F.array(F.lit("")))
    rows = saved(rows, "url-step")  # each step reads its rows several times, so its plan starts from a table
    done, step = None, 0
    while True:
        # Paths without a further segment are done; the others go one step down.
        here = F.try_element_at(F.col("segments"), F.lit(step + 1))
        over = rows.where(F.size("segments") <= step).drop("segments", "branch")
        done = over if done is None else done.unionByName(over)
        inner = rows.where(F.size("segments") > step).withColumn("segment", here)
        if step == DEPTH or inner.isEmpty():
            tail = F.array_append("way", F.concat(F.col("branch"), F.lit("/**")))
            done = done.unionByName(inner.withColumn("way", tail).drop("segments", "branch", "segment"))
            return done.select("host", "path", "n", "labelled", "bad", "way", F.element_at("way", -1).alias("template"))
        sums = (F.sum(c).alias(c) for c in ("n", "labelled", "bad"))
        seen = inner.groupBy("host", "branch", "segment").agg(*sums)
        whole = seen.groupBy("host", "branch").agg(F.sum("n").alias("all_n"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        share = (F.col("all_bad") + 1) / (F.col("all_labelled") + 2)
        error = F.sqrt(share * (1 - share) / F.greatest(F.lit(1), "labelled"))
        clear = (F.col("labelled") >= LEAST_LABELS) & (F.abs(F.col("bad") / F.greatest(F.lit(1), "labelled") - share) >= CLEAR * error)
        many = F.col("n") >= F.greatest(F.lit(LEAST_PAGES), F.lit(LEAST_SHARE) * F.col("all_n"))
        literal = seen.join(whole, ["host", "branch"]).where(many | clear)
        # Only literals meet in these windows: 20 by their number of pages at most, and those with clear labels.
        by_share = Window.partitionBy("host", "branch").orderBy((F.col("bad") + 1) / (F.col("labelled") + 2), "segment")
        n0, b0 = F.lag("labelled").over(by_share), F.lag("bad").over(by_share)
        pool = (F.col("bad") + b0 + 1) / (F.col("labelled") + n0 + 2)
        gap = F.abs((F.col("bad") + 1) / (F.col("labelled") + 2) - (b0 + 1) / (n0 + 2)) / F.sqrt(pool * (1 - pool) * (1 / (F.col("labelled") + 2) + 1 / (n0 + 2)))
        literal = literal.withColumn("starts", F.when(gap <= APART, 0).otherwise(1))
        literal = literal.withColumn("group", F.sum("starts").over(by_share))
        merged = literal.withColumn("name", F.min("segment").over(Window.partitionBy("host", "branch", "group")))
        size = F.count(F.lit(1)).over(Window.partitionBy("host", "branch", "group"))
        merged = merged.withColumn("name", F.when(size > 1, F.concat("name", F.lit("|+"), size - 1)).otherwise(F.col("name")))
        # Names of few literals meet paths of many rows, of which a host may hold a third: the literals are few enough to copy, or AQE splits the join.
        inner = inner.join(merged.select("host", "branch", "segment", "name"), ["host", "branch", "segment"], "left")
        inner = inner.withColumn("branch", F.concat_ws("/", "branch", F.coalesce("name", _variable(F.col("segment")))))
        rows = saved(inner.withColumn("way", F.array_append("way", F.col("branch"))).drop("segment", "name"), "url-step")
        step += 1


def template_purity(rows: DataFrame) -> DataFrame:
    """host, template, purity: bad shares of labelled pages, smoothed from the whole table down each way."""
    whole = rows.agg(((F.sum("bad") + 1) / (F.sum("labelled") + 2)).alias("p")).first()["p"] or 0.5
    ways = saved(rows.groupBy("host", "way").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), "url-ways")
    steps = ways.select("host", "way", "labelled", "bad", F.posexplode("way").alias("step", "node"))
    nodes = steps.groupBy("host", "node").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    along = steps.select("host", "way", "step", "node").join(nodes, ["host", "node"]).groupBy("host", "way").agg(
        F.array_sort(F.collect_list(F.struct("step", "labelled", "bad"))).alias("along"))
    purity = F.aggregate("along", F.lit(float(whole)), lambda above, node: (node["bad"] + PRIOR * above) / (node["labelled"] + PRIOR))
    return along.select("host", F.element_at("way", -1).alias("template"), purity.alias("purity"))


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, bad: Column | None = None, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for every row.

    A page is labelled by `bad`, and where that is null by its rule, if one fits; all others
    are unlabelled and don't count in a purity. A rule's verdict always holds. A null url and one without `://` have an empty host and path, and the tree
    of that host. Rows that repeat an id or url each have their verdict. An empty table
    gives no rows; further columns are not read.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), (bad if bad is not None else F.lit(None)).cast("boolean").alias("given"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("says", says)
    marked = F.coalesce("given", F.col("says") == "block")
    paths = rows.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count(marked).alias("labelled"), F.coalesce(F.sum(marked.cast("long")), F.lit(0)).alias("bad"))
    placed = saved(path_templates(paths), "url-templates")
    purity = template_purity(placed)
    by_path = placed.select("host", "path", "template").join(purity, ["host", "template"])
    verdict = F.coalesce("says", F.when(F.col("purity") >= limit, "block").otherwise("allow"))
    return rows.join(by_path, ["host", "path"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"))
