"""Verdicts on URLs from path templates of each host.

Paths of a host form a tree. From the root down, a segment stays as it is if its labelled rate
differs significantly from its siblings', and else becomes a wildcard; branches without labels have a wildcard
of their own where few labels would speak for many pages. A template is rejected if its share of blocked labels,
smoothed towards the host's and the host's towards all hosts', reaches a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_dir

SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """Struct (length, rule, verdict) of the longest rule (verdict, host, path) that fits, or null.

    One expression; for lists of many thousands of rules a join on host suffixes would take its place.
    """
    fits = [
        F.when(
            ((host == h) | host.endswith("." + h)) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def dealt_join(paths: DataFrame, templates: DataFrame, keys: list[str]) -> DataFrame:
    """Join paths to the one row of their template; those of a large one are dealt over SALTS copies of that row."""
    dealt = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return paths.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(dealt, [*keys, "salt"]).drop("salt")


def _common(a: Column, b: Column) -> Column:
    """Number of first elements in which two arrays agree."""
    other = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(other > 0, other - 1).otherwise(F.size(a)).cast("int")


def _steps(parts: Column) -> Column:
    return F.concat_ws("", F.transform(parts, lambda p: F.concat(F.lit("/"), p)))


def _first(parts: Column, n: Column) -> Column:
    return F.slice(parts, F.lit(1), n)


def _after(parts: Column, n: Column) -> Column:
    return F.slice(parts, n + 1, F.size(parts))


def _skip_shared(open_paths: DataFrame, columns: list[str]) -> DataFrame:
    """Follow each template to the next segment in which its labelled paths differ.

    Up to there the one labelled branch stays, and a path that leaves it has no labels: the rest of it is
    wildcards. Least and greatest labelled path agree exactly as far as all labelled paths do.
    """
    seen = F.when(F.col("labelled") > 0, F.col("rest"))
    ends = open_paths.groupBy("host", "template").agg(F.min(seen).alias("low"), F.max(seen).alias("high"))
    ends = ends.select("host", "template", F.coalesce(_first(F.col("low"), _common(F.col("low"), F.col("high"))), F.array().cast("array<string>")).alias("shared"), F.col("low").isNull().alias("silent"))
    both = dealt_join(open_paths, ends, ["host", "template"]).withColumn("k", _common(F.col("rest"), F.col("shared")))
    # a path that only is a beginning of what is shared has k elements and no rest
    k = F.least("k", F.size("rest"), F.size("shared"))
    leaves = F.col("silent") | (k < F.size("shared"))
    stars = F.when(leaves, F.repeat(F.lit("/*"), F.size("rest") - k)).otherwise("")
    rest = F.when(leaves, F.array().cast("array<string>")).otherwise(_after(F.col("rest"), k))
    return both.select(*columns, F.concat("template", _steps(_first(F.col("rest"), k)), stars).alias("template"), rest.alias("rest"))


def _name_branches(open_paths: DataFrame, columns: list[str], z: float) -> DataFrame:
    """Name the next segment of every path by what the labels of its branch and of its siblings say."""
    here = open_paths.withColumn("part", F.get("rest", F.lit(0)))
    branch = here.groupBy("host", "template", "part").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    parent = branch.groupBy("host", "template").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"))
    others = F.col("pl") - F.col("l")
    pooled = F.col("pb") / F.col("pl")
    gap = F.col("b") / F.col("l") - (F.col("pb") - F.col("b")) / others
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("l") + 1 / others))
    differs = F.when((F.col("l") > 0) & (others > 0), F.abs(gap) > z * error).otherwise(F.col("l") > 0)
    both = branch.join(parent, ["host", "template"]).withColumn("stays", differs)
    merged = both.groupBy("host", "template").agg(F.sum(F.when(~F.col("stays"), F.col("l"))).alias("ml"), F.sum(F.when(F.col("l") == 0, F.col("n"))).alias("silent"))
    speaks = (F.col("l") > 0) | (F.col("ml") == 0) | (F.col("ml") >= F.col("silent"))
    name = F.when(F.col("stays"), F.col("part")).when(speaks, F.lit("*")).otherwise("?")
    named = both.join(merged, ["host", "template"]).select("host", "template", "part", F.concat(F.lit("/"), name).alias("step"))
    step = here.join(named, ["host", "template", "part"])
    return step.select(*columns, F.concat("template", "step").alias("template"), _after(F.col("rest"), F.lit(1)).alias("rest"))


def path_templates(paths: DataFrame, z: float = 1.96) -> DataFrame:
    """``paths`` (host, path, n, labelled, blocked: one row each) with their ``template``.

    A segment stays if it has labels and its labelled rate differs from that of the other labelled pages of
    the parent by ``z`` standard errors, or no others are labelled. The other labelled branches merge into
    ``*``. Branches without labels join them where those labels are at least as many as the pages they would
    speak for, or none; else they become ``?``, which no path contains.

    A round goes to the next segment in which a template's labelled paths differ, however far that is, and
    names it. Templates without labels, or with one labelled path, end at once, so no single path decides
    the number of rounds: it is that of forks between labelled paths on one way down. A round's paths are
    written, and what has ended is read from all rounds' tables in one scan.
    """
    columns, spark = paths.columns, paths.sparkSession
    tree = paths.withColumn("template", F.lit("")).withColumn("rest", F.filter(F.split("path", "/"), lambda s: s != ""))
    tables, schema = [], tree.schema

    def written(df: DataFrame) -> DataFrame:
        tables.append(work_dir(spark, "paths"))
        df.write.parquet(tables[-1])
        return spark.read.schema(schema).parquet(tables[-1]).filter(F.size("rest") > 0)

    tree = written(tree)
    while not tree.isEmpty():
        tree = written(_skip_shared(tree, columns))
        tree = written(_name_branches(tree, columns, z))
    return spark.read.schema(schema).parquet(*tables).filter(F.size("rest") == 0).drop("rest")


def template_verdicts(pages: DataFrame, weight: float = 2.0, threshold: float = 0.5) -> DataFrame:
    """Template, ``purity`` (smoothed share of blocked labels) and ``rejected`` of every (host, path).

    ``pages`` has host, path and blocked (true, false, or null where unlabelled). Pages are summed by
    path before anything is joined. No labels at all: purity is one half of ``weight`` observations and
    nothing is rejected. A null host or path is an empty one; repeated rows count as often as they stand. An
    empty table gives no rows.
    """
    labelled = F.count("blocked")
    pages = pages.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    paths = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), labelled.alias("labelled"), F.count_if("blocked").alias("blocked"))
    named = path_templates(paths)
    leaf = named.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    hosts = leaf.groupBy("host").agg(F.sum("l").alias("hl"), F.sum("b").alias("hb"))
    total = hosts.agg(F.coalesce(F.sum("hl"), F.lit(0)).alias("al"), F.coalesce(F.sum("hb"), F.lit(0)).alias("ab"))
    rate = hosts.join(F.broadcast(total)).select("host", ((F.col("hb") + weight * (F.col("ab") + weight / 4) / (F.col("al") + weight / 2)) / (F.col("hl") + weight)).alias("rate"))
    purity = (F.col("b") + weight * F.col("rate")) / (F.col("l") + weight)
    judged = leaf.join(rate, "host").select("host", "template", purity.alias("purity"), (purity > threshold).alias("rejected"))
    return dealt_join(named.select("host", "path", "template"), judged, ["host", "template"])
