"""URL filters: explicit host and path rules, and a path-template tree for the rest.

The tree is built per host, level by level, from aggregated path shapes rather
than rows.  At each level a segment whose siblings are too many and too spread
out becomes the wildcard ``*``; siblings whose labelled rate and whose spread of
children do not differ significantly from those of all siblings together become
one merged branch ``+``.  A template is rejected when the smoothed share of bad
labels among its pages is high enough.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entailis.llm.common import ascii_lower, checkpoint

#: Levels that the SQL of the tree writes out; the tree itself is as deep as the paths are.
LEVELS = 6
#: Parts into which the branches of one prefix, and the shapes of one branch, are dealt in joins.
SALTS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null where none fits.

    rules: (block or allow, ``host/path``), short enough to be part of the plan.
    A rule fits its host and all subdomains if the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the longest is tested first
        name, slash, tail = r.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _shape(path: Column) -> Column:
    """The segments of a path with numbers and hexadecimal names generalised."""
    return F.transform(
        F.filter(F.split(path, "/"), lambda s: s != ""),
        lambda s: F.regexp_replace(F.regexp_replace(s, r"^(?=[0-9a-fA-F-]*[0-9])[0-9a-fA-F-]{8,}(?=\.|$)", "{hex}"), r"^[0-9]+(?=\.|$)", "{num}"),
    )


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def path_templates(
    pages: DataFrame, bad: Column, host: str = "host", path: str = "path", *, variable_children: int = 20, variable_top: float = 0.5, merge_z: float = 1.96, merge_support: int = 20
) -> DataFrame:
    """(host, shape array, template, n_pages, n_labelled, n_bad) of every path shape.

    bad: 1 or 0 for labelled pages, null for others.  A segment position is
    variable when it has at least ``variable_children`` children of which none
    holds ``variable_top`` of the pages.  Branches merge when both their
    labelled rate and their share of leaves lie within ``merge_z`` standard
    errors of the parent's, each with ``merge_support`` observations.
    All statistics are aggregates over all rows, combined before the shuffle.
    There is a round for each level; a shape that has a branch to itself is
    settled at once, so rounds go as deep as paths share their templates.
    """
    shapes = pages.select(F.col(host).alias("host"), _shape(F.col(path)).alias("shape"), bad.cast("int").alias("bad"))
    shapes = shapes.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("lab"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bads"))
    tree = checkpoint(shapes.withColumn("prefix", F.lit("")).withColumn("done", F.lit(False)))
    # An only child holds all pages of its parent, so it stays as it is, and so do its own.
    settles = variable_children > 1 or variable_top <= 1
    for level in count():
        seg, ends = F.when(~F.col("done"), F.get(F.col("shape"), F.lit(level))), F.size("shape") == level + 1
        child = tree.where(seg.isNotNull()).groupBy("host", "prefix", seg.alias("seg"))
        child = child.agg(*(F.sum(c).alias(c) for c in ("n", "lab", "bads")), F.sum(F.when(ends, F.col("n")).otherwise(0)).alias("leaves"))
        parent = child.groupBy("host", "prefix").agg(
            F.count(F.lit(1)).alias("children"), F.max("n").alias("top"), F.sum("n").alias("pn"), F.sum("lab").alias("plab"), F.sum("bads").alias("pbads"), F.sum("leaves").alias("pleaves")
        )
        # A host may have millions of segments below one prefix, and a segment as many shapes: both joins deal them by a salt.
        spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        both = child.withColumn("salt", _salt("seg")).join(parent.select("*", spread), ["host", "prefix", "salt"])

        def near(hits: Column, of: Column, all_hits: Column, all_of: Column) -> Column:
            rate = F.try_divide(all_hits, all_of)
            return (of >= merge_support) & (F.abs(F.try_divide(hits, of) - rate) <= merge_z * F.sqrt(F.try_divide(rate * (1 - rate), of)))

        c = F.col
        merged = (c("children") > 1) & near(c("bads"), c("lab"), c("pbads"), c("plab")) & near(c("leaves"), c("n"), c("pleaves"), c("pn"))
        variable = (c("children") >= variable_children) & (c("top") < variable_top * c("pn"))
        step = both.select("host", "prefix", "seg", F.when(variable, F.lit("*")).when(F.coalesce(merged, F.lit(False)), F.lit("+")).otherwise(c("seg")).alias("token"))
        tree = tree.withColumn("seg", F.coalesce(seg, F.lit(""))).withColumn("salt", _salt("shape")).join(step.select("*", spread), ["host", "prefix", "seg", "salt"], "left")
        tree = checkpoint(tree.withColumn("prefix", F.when(c("token").isNotNull(), F.concat("prefix", F.lit("/"), "token")).otherwise(c("prefix"))).drop("seg", "token", "salt"))
        if not tree.where((F.size("shape") > level + 1) & ~c("done")).take(1):
            break
        if settles:
            alone = tree.where("not done").groupBy("host", "prefix").agg(F.count(F.lit(1)).alias("shapes")).where("shapes = 1")
            tree = tree.join(alone, ["host", "prefix"], "left").withColumn("now", ~c("done") & c("shapes").isNotNull() & (F.size("shape") > level + 1))
            rest = F.concat("prefix", F.lit("/"), F.array_join(F.slice("shape", level + 2, F.size("shape")), "/"))
            tree = checkpoint(tree.withColumn("prefix", F.when(c("now"), rest).otherwise(c("prefix"))).withColumn("done", c("done") | F.coalesce("now", F.lit(False))).drop("shapes", "now"))
            if not tree.where((F.size("shape") > level + 1) & ~c("done")).take(1):
                break
    totals = tree.groupBy("host", F.col("prefix").alias("template")).agg(F.sum("n").alias("n_pages"), F.sum("lab").alias("n_labelled"), F.sum("bads").alias("n_bad"))
    return tree.select("host", "shape", F.col("prefix").alias("template")).join(totals, ["host", "template"]).select("host", "shape", "template", "n_pages", "n_labelled", "n_bad")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labels: Column | None = None, *, key: str = "page_id", url: str = "url", purity: float = 0.9, smoothing: float = 2.0) -> DataFrame:
    """(key, host, path, rule, verdict, template, bad_share), one row for each row of pages.

    The verdict of the longest fitting rule, else that of the page's template:
    ``block`` if (bad + smoothing/2) / (labelled + smoothing) >= purity.  labels:
    1 for bad pages, 0 for good ones, null for the rest; by default the verdicts
    of the rules themselves are the labels.  Null urls and urls without ``://``
    have an empty host and path and the template ``""`` of that host.  Repeated
    rows stay; other columns are not read; an empty table gives an empty table.
    """
    at = pages.select(F.col(key).alias("__key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), (F.lit(None).cast("int") if labels is None else labels.cast("int")).alias("__given"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    at = at.withColumn("rule", rule).withColumn("said", said).withColumn("shape", _shape(F.col("path")))
    bad = F.col("__given") if labels is not None else F.when(F.col("said").isNotNull(), (F.col("said") == "block").cast("int"))
    templates = path_templates(at, bad)
    # Written once, so that a hot shape of the join below can be split among tasks.
    templates = checkpoint(templates.withColumn("bad_share", (F.col("n_bad") + smoothing / 2) / (F.col("n_labelled") + smoothing)).select("host", "shape", "template", "bad_share"))
    verdict = F.coalesce("said", F.when(F.col("bad_share") >= purity, F.lit("block")).otherwise(F.lit("allow")))
    return at.join(templates, ["host", "shape"], "left").select(F.col("__key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "template", "bad_share")
