"""Line dedup by site-relative frequency.

Of each host, the share of pages that hold a line is the number of its pages with the line over the number of all its
pages.  A line on more than ``RATIO`` of its host's pages, and on ``LEAST_PAGES`` pages at least, is boilerplate there and
is dropped from all of them; other lines keep their place.

Plan: lines become (host, digest) pairs, each once a page, and are counted with partial aggregation before the shuffle, so
a host with a third of all pages, or a line on all of them, is a few partial counts per task.  The host totals are counted
the same way.  The frequent lines are written as one array per host: a host has at most ``1 / RATIO`` times its average
number of lines per page of them, whatever its size.  Their number is then known: up to ``BROADCAST_LINES`` they are
broadcast and no text is shuffled; beyond, each host's array meets its pages in ``SALT`` places, so that a host with a third
of all pages is dealt to as many tasks.

Defined results: lines are split at line feeds and compared trimmed (spaces, tabs and carriage returns); blank lines are
never boilerplate and are kept; a null text stays null; pages with a null host form one host; a page that appears in
several rows counts as several pages, unless ``copies`` is off; an empty table gives an empty result; other columns pass through under any name, but
the two counts replace columns of their names.  Two lines are the same if their 64-bit digests are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import core

RATIO, LEAST_PAGES = 0.1, 3
#: Frequent lines that are broadcast, at 8 bytes each and some more for each host.
BROADCAST_LINES, SALT = 2_000_000, 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _digest(line: Column) -> Column:
    """0 stands for a blank line."""
    return F.when(_trim(line) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(_trim(line)))


def frequent_lines(docs: DataFrame, host: Column, ratio: float = RATIO, least: int = LEAST_PAGES, text: str = "text", copies: bool = True) -> DataFrame:
    """_host and _common: the digests of the lines that are boilerplate there."""
    digests = F.array_distinct(F.transform(_lines(F.coalesce(F.col(text), F.lit(""))), _digest))
    pages = docs.select(host.alias("_host"), digests.alias("_digests"))
    if not copies:
        pages = pages.withColumn("_digests", F.array_remove("_digests", F.lit(0).cast("long"))).distinct()
    counts = pages.select("_host", F.explode("_digests").alias("_digest")).where("_digest <> 0").groupBy("_host", "_digest").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    totals = pages.groupBy("_host").agg(F.count("*").alias("_total"))
    both = counts.join(totals, counts["_host"].eqNullSafe(totals["_host"])).drop(totals["_host"])
    return both.where(F.col("_n") > F.col("_total") * ratio).groupBy("_host").agg(F.collect_set("_digest").alias("_common"))


def drop_lines(docs: DataFrame, host: Column, ratio: float = RATIO, least: int = LEAST_PAGES, text: str = "text", counts: bool = True, copies: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines taken from ``text``, and _n_lines and _n_dropped, if ``counts``.

    Without ``copies``, pages of a host with the same lines count as one page, so that a group of copies can't make its own
    text boilerplate."""
    at, there, common, left = core.unused(docs, "_host", "_common_host", "_common", "_kept")
    spark = docs.sparkSession
    frequent = core.materialise(frequent_lines(docs, host, ratio, least, text, copies).withColumnsRenamed({"_host": there, "_common": common}), "frequent-lines")
    n = frequent.agg(F.sum(F.size(common) + 8)).first()[0] or 0  # a host counts as eight lines
    if n <= BROADCAST_LINES:
        joined = docs.withColumn(at, host).join(F.broadcast(frequent), F.col(at).eqNullSafe(F.col(there)), "left").drop(at, there)
    else:
        salt, dealt = core.unused(docs, "_salt", "_dealt")
        many = frequent.crossJoin(F.broadcast(spark.range(SALT).select(F.col("id").cast("int").alias(dealt))))
        both = F.col(at).eqNullSafe(F.col(there)) & (F.col(salt) == F.col(dealt))
        salted = docs.withColumns({at: host, salt: F.pmod(F.xxhash64(text), F.lit(SALT)).cast("int")})
        joined = salted.join(many.hint("shuffle_hash"), both, "left").drop(at, there, salt, dealt)
    lines = _lines(F.col(text))
    kept = F.when(F.col(common).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(common, _digest(x))))
    out = joined.withColumn(left, kept)
    sizes = {"_n_lines": F.size(lines), "_n_dropped": F.size(lines) - F.size(left)} if counts else {}
    return out.select(
        *(F.array_join(left, "\n").alias(c) if c.lower() == text.lower() else core.column(c) for c in docs.columns if c.lower() not in sizes),
        *(F.coalesce(n, F.lit(0)).cast("long").alias(name) for name, n in sizes.items()),
    )


def page_lines(html: Column) -> Column:
    """Text lines of an HTML page: each tag ends a line."""
    return F.regexp_replace(html, "<[^>]*>", "\n")


def page_host(url: Column) -> Column:
    """The host in lower case, without user and port; null without a scheme."""
    return F.nullif(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
