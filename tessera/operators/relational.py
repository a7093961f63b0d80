"""Relational operators that are not specific to attribution data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import materialise


def mode_smallest(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """A4: the most frequent value of each group, the smallest of equally frequent; nulls don't count, and a group of nulls
    only has none.  Counts are aggregated partially before the shuffle."""
    counts = df.groupBy(*keys, value).agg(F.count(F.col(value)).alias("_n"))
    best = F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))))
    return counts.groupBy(*keys).agg(best["v"].alias(name))


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts in long form; rows without either value are left out."""
    return df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count("*").alias("n"))


def crosstab_wide(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """One column per value, zero-filled, in the order given."""
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    return known.groupBy(row).agg(*(F.count(F.when(F.col(column) == v, 1)).alias(str(v)) for v in values))


def column_order(df: DataFrame, row: str, column: str) -> DataFrame:
    """Columns by their mean over all rows, zeros included, descending."""
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    rows = known.agg(F.count_distinct(row).alias("_rows"))
    means = known.groupBy(column).agg(F.count("*").alias("_n")).crossJoin(F.broadcast(rows))  # the one-row total
    means = means.select(column, (F.col("_n") / F.col("_rows")).alias("mean_n"))
    return means.withColumn("position", F.row_number().over(Window.orderBy(F.desc("mean_n"), column)) - 1)


def _levels(length: Column) -> Column:
    """The power of two that an interval of this length is cut by."""
    return F.greatest(F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double"))), F.lit(0)).cast("int")


def _bins(start: Column, stop: Column, level: Column) -> Column:
    """Bins of width 2 ** level that [start, stop) touches."""
    size = F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(start / size).cast("bigint"), F.floor(F.greatest(stop - 1, start) / size).cast("bigint"))


def overlap_flag(a: DataFrame, b: DataFrame, key: str, fraction: float = 0.4, name: str = "found") -> DataFrame:
    """Whether an interval [start, stop) of ``a`` is overlapped by one of ``b`` under the same key, over at least
    ``fraction`` of its own length.  Adds one flag to every row of ``a``.

    An interval of ``b`` lies in the two bins of its own magnitude, so a long one does not widen the bins of the others.  One
    of ``a`` is looked up in the magnitudes that can hold so large an overlap, a few bins each.  The flag follows from the
    key and the bounds, so it is found once for each of these and comes back by them.
    """
    own = a.select(F.col(key).alias("_key"), F.col("start").alias("_a0"), F.col("stop").alias("_a1")).where("_key IS NOT NULL AND _a1 > _a0").distinct()
    present = [r[0] for r in b.where(F.col("stop") > F.col("start")).select(_levels(F.col("stop") - F.col("start")).alias("l")).distinct().collect()]  # 64 at most
    levels = F.filter(F.array(*map(F.lit, sorted(present))).cast("array<int>"), lambda x: F.pow(F.lit(2.0), x) >= fraction * (F.col("_a1") - F.col("_a0")))
    left = own.withColumn("_level", F.explode(levels)).withColumn("_bin", F.explode(_bins(F.col("_a0"), F.col("_a1"), F.col("_level"))))
    sized = b.where(F.col("stop") > F.col("start")).select(F.col(key).alias("_bkey"), F.col("start").alias("_b0"), F.col("stop").alias("_b1")).withColumn("_blevel", _levels(F.col("_b1") - F.col("_b0")))
    right = sized.withColumn("_bbin", F.explode(_bins(F.col("_b0"), F.col("_b1"), F.col("_blevel"))))
    shared = F.least("_a1", "_b1") - F.greatest("_a0", "_b0")
    same = (F.col("_key") == F.col("_bkey")) & (F.col("_level") == F.col("_blevel")) & (F.col("_bin") == F.col("_bbin"))
    hits = left.join(right, same & (shared > 0) & (shared >= fraction * (F.col("_a1") - F.col("_a0"))), "left_semi").select("_key", "_a0", "_a1").distinct()
    back = (F.col(key) == F.col("_key")) & (F.col("start") == F.col("_a0")) & (F.col("stop") == F.col("_a1"))
    return a.join(hits, back, "left").withColumn(name, F.col("_a0").isNotNull()).drop("_key", "_a0", "_a1")


def overlap_semi(a: DataFrame, b: DataFrame, key: str, fraction: float = 0.4) -> DataFrame:
    return overlap_flag(a, b, key, fraction, "_found").where("_found").drop("_found")


def _with_stats(df: DataFrame, stats: list[Column]) -> DataFrame:
    """Every row beside the one row of global statistics."""
    return df.crossJoin(F.broadcast(df.agg(*stats)))


def zscore(df: DataFrame, columns: list[str], sample: bool = True) -> DataFrame:
    """By the standard deviation of a sample (ddof 1) or of the population."""
    sd = F.stddev_samp if sample else F.stddev_pop
    wide = _with_stats(df, [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", sd))])
    return wide.select(*df.columns, *(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")).alias(f"{c}_z") for c in columns))


def minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scaled to 0..1; a constant column stays as it is."""
    wide = _with_stats(df, [f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda c: F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(F.col(c))
    return wide.select(*df.columns, *(scaled(c).alias(f"{c}_scaled") for c in columns))


def corr_matrix(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """Pearson correlation of every left with every right column, long form, in one aggregation."""
    row = df.agg(*(F.corr(a, b).alias(f"c{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(right)))
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}_{j}").alias("corr")) for i, a in enumerate(left) for j, b in enumerate(right)]
    return row.select(F.inline(F.array(*pairs)))


def index_ranges(df: DataFrame, order: str, label: str, size: str) -> DataFrame:
    """Consecutive index ranges [lo, hi) from sizes in order."""
    upto = F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.select(label, (upto - F.col(size)).alias("lo"), upto.alias("hi"))


def range_lookup(df: DataFrame, index: str, ranges: DataFrame, label: str) -> DataFrame:
    """The label of the range [lo, hi) that holds the index; ranges do not overlap.

    Ranges lie in the bins of their own magnitude, so each magnitude is an equi-join that finds one range at most.
    """
    sized = ranges.where("hi > lo").select(F.struct(F.col(label).alias("v")).alias("_v"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi")).withColumn("_level", _levels(F.col("_hi") - F.col("_lo")))
    out, found = df, []
    for level in sorted(r[0] for r in sized.select("_level").distinct().collect()):  # 64 at most
        own = sized.where(F.col("_level") == level).withColumn("_bin", F.explode(_bins(F.col("_lo"), F.col("_hi"), F.lit(level))))
        part = own.select(F.col("_v").alias(f"_v{level}"), F.col("_lo").alias(f"_lo{level}"), F.col("_hi").alias(f"_hi{level}"), F.col("_bin").alias(f"_bin{level}"))
        held = (F.floor(F.col(index) / F.lit(2.0**level)).cast("bigint") == F.col(f"_bin{level}")) & (F.col(index) >= F.col(f"_lo{level}")) & (F.col(index) < F.col(f"_hi{level}"))
        out = out.join(part, held, "left").drop(f"_lo{level}", f"_hi{level}", f"_bin{level}")
        found.append(f"_v{level}")
    value = F.coalesce(*map(F.col, found))["v"] if found else F.lit(None).cast(dict(ranges.dtypes)[label])
    return out.withColumn(label, value).drop(*found)


def row_mean(df: DataFrame, columns: list[str], name: str = "mean") -> DataFrame:
    """Mean over some columns of a row; null if one of them is."""
    return df.withColumn(name, sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns))


def max_above(df: DataFrame, columns: list[str], least: float) -> DataFrame:
    """Rows whose greatest value of some columns is above ``least``."""
    return df.where(F.greatest(*columns) > least) if len(columns) > 1 else df.where(F.col(columns[0]) > least)


def beside(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of two tables side by side, by their common row id."""
    return left.join(right, key)


def region_label(df: DataFrame, region: str, name: str, sep: str = ".") -> DataFrame:
    """Of each region, the first in order of the prefixes of its rows' names."""
    return df.where(F.col(name).isNotNull()).groupBy(region).agg(F.min(F.split_part(F.col(name), F.lit(sep), F.lit(1))).alias("label"))


def region_ids(df: DataFrame, names: DataFrame, example: str, region: str) -> DataFrame:
    """The distinct regions of the examples of ``df``, in order; ``names`` has one row per example."""
    return df.select(example).distinct().join(names.select(example, region), example).select(region).distinct().orderBy(region)


def relative_index(df: DataFrame, index: str, size: int, name: str = "relative") -> DataFrame:
    """The place of an example in its group of ``size``."""
    return df.withColumn(name, F.pmod(F.col(index), F.lit(size)))


def without_noise(df: DataFrame, dbd: str, only: str | None = None) -> DataFrame:
    """Rows with a domain, or with this one; the text "nan" is none."""
    return df.where(F.col(dbd) != "nan") if only is None else df.where(F.col(dbd) == only)


def relabel(df: DataFrame, column: str, names: dict[str, str], suffix: Column | None = None, strip: str | None = None) -> DataFrame:
    """Values renamed by a dictionary, then without the prefix ``strip``, then with ".suffix"."""
    value = F.col(column)
    if names:
        pairs = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
        value = F.coalesce(F.try_element_at(pairs, value), value)
    if strip:
        value = F.regexp_replace(value, f"^{strip}", "")
    return df.withColumn(column, F.concat_ws(".", value, suffix) if suffix is not None else value)


def split_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """How many values each combination of keys has."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"))


def first_per_class(df: DataFrame, label: str, order: str) -> DataFrame:
    """The first row of each class."""
    return df.groupBy(label).agg(F.min_by(F.struct(*(c for c in df.columns if c != label)), order).alias("_r")).select(label, "_r.*")


def extent(df: DataFrame, key: str, margin: int = 10) -> DataFrame:
    """The stretch that holds all spans of a key, and a margin."""
    return df.groupBy(key).agg((F.min("start") - margin).alias("low"), (F.max("stop") + margin).alias("high"))


def sequence_join(left: DataFrame, right: DataFrame, order: str, value: str) -> DataFrame:
    """The value of the row of ``right`` with the same one-hot sequence ``oh``, the last of equal ones by ``order``; rows
    without one get null.  Sequences travel as fingerprints."""
    from tessera.functions.arrays import fingerprint

    named = right.select(fingerprint(F.col("oh")).alias("_print"), value, order).groupBy("_print").agg(F.max_by(value, order).alias(value))
    return left.withColumn("_print", fingerprint(F.col("oh"))).join(named, "_print", "left").drop("_print")


def share_sorted(df: DataFrame, group: str, flag: Column) -> DataFrame:
    """Per group, percent of rows without the flag, ascending."""
    return df.groupBy(group).agg((F.avg(F.when(flag, 0.0).otherwise(1.0)) * 100).alias("percent")).orderBy("percent", group)


def first_by(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first non-null value of each group by an explicit order."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def by_count(df: DataFrame, column: str) -> DataFrame:
    """Values by how often they occur."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def resize(df: DataFrame, size: int, chrom_sizes: DataFrame) -> DataFrame:
    """Regions of ``size`` around their middle; those that leave their chromosome go."""
    mid = F.col("start") + F.expr("(stop - start) div 2")
    out = df.withColumns({"_mid": mid}).withColumns({"start": F.col("_mid") - size // 2, "stop": F.col("_mid") + size // 2 + size % 2}).drop("_mid")
    return out.join(chrom_sizes, "chrom").where((F.col("start") >= 0) & (F.col("stop") <= F.col("chrom_size"))).drop("chrom_size")


def genomic(seqlets: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Coordinates in the genome, from those in the region."""
    r = regions.select(key, F.col("chrom"), F.col("start").alias("_region_start"))
    return seqlets.join(r, key).withColumns({"g_start": F.col("_region_start") + F.col("start"), "g_stop": F.col("_region_start") + F.col("stop")}).drop("_region_start")


def signal_mean(spans: DataFrame, signal: DataFrame, pad: int = 10, bin_size: int = 1000) -> DataFrame:
    """Mean signal over [start - pad, stop + pad), weighted by coverage; null where no signal lies.

    Both sides are cut into bins of positions, so a chromosome is spread over many tasks; a mean follows from the bounds and
    comes back by them.
    """
    own = spans.select(F.col("chrom").alias("_c"), F.col("start").alias("_s0"), F.col("stop").alias("_s1")).distinct()
    own = own.withColumns({"_lo": F.greatest(F.col("_s0") - pad, F.lit(0)), "_hi": F.col("_s1") + pad})
    left = own.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") / bin_size), F.floor((F.col("_hi") - 1) / bin_size))))
    right = signal.select("chrom", F.col("start").alias("_s"), F.col("stop").alias("_e"), "value", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("stop") - 1) / bin_size))).alias("_sbin"))
    shared = F.least("_hi", "_e", (F.col("_bin") + 1) * bin_size) - F.greatest("_lo", "_s", F.col("_bin") * bin_size)
    hit = left.join(right, (F.col("_c") == F.col("chrom")) & (F.col("_bin") == F.col("_sbin"))).where(shared > 0)
    mean = hit.groupBy("_c", "_s0", "_s1").agg((F.sum(F.col("value") * shared) / F.sum(shared)).alias("signal"))
    back = (F.col("chrom") == F.col("_c")) & (F.col("start") == F.col("_s0")) & (F.col("stop") == F.col("_s1"))
    return spans.join(mean, back, "left").drop("_c", "_s0", "_s1")


def in_order(ordered: DataFrame) -> DataFrame:
    """A sorted table with ``position``, the place of each row from 0.

    The sorted rows are written once, each with its range and its place in it; what was written is numbered by the counts of
    the ranges before, so the sort is not gathered in one task and no number depends on a second run of the plan."""
    kept = materialise(ordered.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "in-order")
    counts = kept.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    return kept.join(F.broadcast(starts), "_part").select(*ordered.columns, (F.col("_before") + F.col("_at")).alias("position"))
