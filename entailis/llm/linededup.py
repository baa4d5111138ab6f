"""Line dedup by distinct-site spread, in DataFrame functions only.

A line is boilerplate if it occurs on at least ``min_sites`` distinct sites.
Lines that occur often enough at all get a HyperLogLog sketch of their sites,
merged by aggregation.  Sketches decide clear cases; lines whose estimate lies
within MARGIN of the threshold get exact distinct counts.  The first copy of a
boilerplate line stays, so no content leaves the corpus altogether.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entailis.llm.common import checkpoint

#: Sites that make a line boilerplate, as OP5_SQL has it.  Lines on fewer sites stay.
MIN_SITES = 10
#: Words that make a line long, where long lines have a threshold of their own.
LONG_WORDS = 51
#: log2 of the sketch's buckets: a standard error of 1.6 %.
SKETCH_LOG2 = 12
#: Relative distance from the threshold within which estimates are not trusted: nine standard errors.
MARGIN = 0.15


def line_key(line: Column) -> list[Column]:
    """128 bits of hash that stand for a line."""
    return [F.xxhash64(line).alias("__h1"), F.xxhash64(F.lit(1), line).alias("__h2")]


def cross_site_lines(lines: DataFrame, min_sites: int = MIN_SITES, long_sites: int | None = None) -> DataFrame:
    """(h1, h2) of boilerplate among lines (h1, h2, site, and long with long_sites); a null site is no site."""
    keys, least = _least(min_sites, long_sites)
    often = lines.groupBy(*keys).agg(F.hll_sketch_agg("__site", SKETCH_LOG2).alias("sketch"))
    judged = checkpoint(often.select(*keys, F.hll_sketch_estimate("sketch").alias("sites")))
    clear = judged.where(F.col("sites") > least * (1 + MARGIN)).select("__h1", "__h2")
    near = judged.where((F.col("sites") >= least * (1 - MARGIN)) & (F.col("sites") <= least * (1 + MARGIN))).select("__h1", "__h2")
    # A line's sites are made distinct before the join, so that a line on very many rows is few of them.
    exact = checkpoint(lines.where("__site is not null").select(*keys, "__site").distinct()).join(near, ["__h1", "__h2"], "left_semi").withColumn("one", F.lit(1))
    exact = exact.groupBy(*keys).agg(F.count("one").alias("n")).where(F.col("n") >= least).select("__h1", "__h2")
    return clear.unionByName(exact)


def _least(min_sites: int, long_sites: int | None) -> tuple[list[str], Column]:
    """(columns that stand for a line, sites that it must be on)."""
    if long_sites is None:
        return ["__h1", "__h2"], F.lit(min_sites)
    return ["__h1", "__h2", "__long"], F.when(F.col("__long"), long_sites).otherwise(min_sites)


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, *, long_sites: int | None = None, long_words: int = LONG_WORDS, key: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """docs without repeated boilerplate lines, with two columns more: n_lines and n_removed.

    A line on fewer than min_sites distinct sites stays, however many documents
    hold it, so a table with fewer sites loses no line.  With long_sites, lines
    of long_words words or more are boilerplate from that many sites on.
    Lines are what ``\\n`` separates; blank ones never count and always stay.
    Of a boilerplate line's occurrences the one with the smallest (key, line
    number) stays, null keys last; all others go.  All rows of docs come back,
    documents that lose every line with an empty text, null texts as null with
    no lines.  Repeated rows are treated alike.  All columns of docs are kept
    as they are but ``text``; names that begin with two underscores are reserved.
    """
    lines = F.split(F.col(text).cast("string"), "\n")
    base = docs.withColumn("__row", F.xxhash64(F.col(text)))
    each = base.select(F.col(key).alias("__key"), "__row", F.col(site).cast("string").alias("__site"), F.posexplode(lines).alias("__pos", "__line")).where(F.trim(F.regexp_replace("__line", r"\s+", "")) != "")
    keys, least = _least(min_sites, long_sites)
    long = [] if long_sites is None else [(F.size(F.split(F.trim(F.regexp_replace("__line", r"\s+", " ")), " ")) >= long_words).alias("__long")]
    each = each.select("__key", "__row", "__site", "__pos", *line_key(F.col("__line")), *long)
    # A line on so many sites occurs so often at least; counts combine before the shuffle.
    often = checkpoint(each.groupBy(*keys).agg(F.count("__site").alias("n")).where(F.col("n") >= least).select("__h1", "__h2"))
    held = checkpoint(each.join(often, ["__h1", "__h2"], "left_semi"))
    spread = checkpoint(cross_site_lines(held, min_sites, long_sites))
    order = F.struct(F.col("__key").isNull().alias("none"), F.col("__key").alias("key"), F.col("__pos").alias("pos"))
    # Minima combine before the shuffle; a join first would bring all rows of a hot line into one task.
    first = checkpoint(held.groupBy("__h1", "__h2").agg(F.min(order).alias("first")).join(spread, ["__h1", "__h2"], "left_semi"))
    later = held.join(first, ["__h1", "__h2"]).where(~order.eqNullSafe(F.col("first")))
    gone = later.groupBy(F.col("__key").alias("__k"), F.col("__row").alias("__r")).agg(F.array_sort(F.collect_set("__pos")).alias("__gone"))
    found = base.join(gone, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__row") == F.col("__r")), "left")
    edge = F.concat(F.array(F.lit(-1)), F.col("__gone"), F.array(F.size(lines)))
    # What lies between two removed lines is one slice.
    parts = F.transform(F.sequence(F.lit(0), F.size("__gone")), lambda i: F.slice(lines, F.get(edge, i) + 2, F.get(edge, i + 1) - F.get(edge, i) - 1))
    left = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(F.flatten(parts), "\n"))
    out = [left.alias(c) if c == text else F.col(c) for c in docs.columns]
    return found.select(*out, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"))
