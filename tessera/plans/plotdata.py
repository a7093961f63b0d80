"""The data that each figure draws, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import relational as R
from tessera.operators import topics as T
from tessera.operators.patterns import representatives, sort_patterns


def _need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def tsne_points(obs: DataFrame, color_by: str = "cluster_dbd") -> DataFrame:
    """V1, P18."""
    _need(obs, "x", "y", "leiden", color_by)
    c = F.col(color_by)
    if dict(obs.dtypes)[color_by] == "string":
        c = F.coalesce(F.when(c != "nan", c), F.lit("Unknown"))
    return obs.select("x", "y", "leiden", c.alias("color"))


def centroids(obs: DataFrame, key: str = "leiden") -> DataFrame:
    """A14."""
    return obs.groupBy(key).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def logo(patterns: DataFrame, least_ic: float = 0.2, least_length: int = 4, whole_if_empty: bool = False) -> DataFrame:
    """trimmed heights; ``too_short`` where fewer positions than ``least_length`` are left."""
    trimmed = patterns.withColumn("_t", A.ic_trim(F.col("ic"), least_ic))
    if whole_if_empty:
        trimmed = trimmed.withColumn("_t", F.when(F.col("_t.start") == F.col("_t.stop"), F.struct(F.lit(0).alias("start"), F.size("ic").alias("stop"))).otherwise(F.col("_t")))
    heights = A.logo_heights(F.col("ppm"), F.col("ic"))
    length = F.col("_t.stop") - F.col("_t.start")
    return trimmed.withColumn("heights", F.slice(heights, F.col("_t.start") + 1, length)).withColumn("too_short", length < least_length).drop("_t")


def tsne_logos(obs: DataFrame, patterns: DataFrame | None, color_by: str = "cluster_dbd", least_ic: float = 0.2) -> DataFrame:
    """V2: a centroid and a logo per cluster; an unknown color_by falls back to leiden."""
    if patterns is None:
        raise ValueError("logos need patterns")
    color_by = color_by if color_by in obs.columns else "leiden"
    colours = obs.groupBy("leiden").agg(F.min(color_by).alias("color"))
    logos = logo(patterns, least_ic, whole_if_empty=True).select("leiden", "heights")
    return centroids(obs).join(logos, "leiden").join(colours, "leiden")


def region_hits(seqlets: DataFrame, length: int, example_idx: int | None = None, region_name: str | None = None, zoom: tuple[int | None, int | None] = (None, None), least: float | None = None) -> DataFrame:
    """The hits of one region inside the zoom window, clamped to it."""
    a, b = zoom
    if (a is None) != (b is None):
        raise ValueError("give both ends of the zoom window or neither")
    if a is not None and (a < 0 or b < 0):
        raise ValueError("the zoom window must not begin or end before the region")
    if a is not None and a >= b:
        raise ValueError("the zoom window must not be empty")
    if a is not None and b > length:
        raise ValueError(f"the zoom window must end inside the region of {length} positions")
    if (example_idx is None) == (region_name is None):
        raise ValueError("name the region by its index or by its name")
    if region_name is not None:
        _need(seqlets, "region_name")
        row = seqlets.where(F.col("region_name") == region_name).agg(F.min("example_idx")).first()
        example_idx = row[0]
        if example_idx is None:
            raise ValueError(f"no region is named {region_name!r}")
    hits = seqlets.where(F.col("example_idx") == example_idx)
    if hits.isEmpty():
        raise ValueError("the region has no hits")
    if least is not None:
        hits = hits.where(F.abs("attribution") >= least)
    if a is not None:
        width = b - a
        hits = hits.withColumns({"start": F.col("start") - a, "end": F.col("end") - a}).where((F.col("end") > 0) & (F.col("start") < width))
        hits = hits.withColumns({"start": F.greatest("start", F.lit(0)), "end": F.least("end", F.lit(width))})
    return hits.orderBy("start")


def dedupe_labels(hits: DataFrame, threshold: float = 25, group: str = "example_idx") -> DataFrame:
    """A hit's domain is its label; a label is kept unless one of its domain that was kept has its centre nearer than
    ``threshold``; kept ones take turns below and above.  A fold over the hits of a region in order of their start."""
    state = F.struct(F.array().cast("array<struct<dbd:string,centre:double>>").alias("kept"), F.array().cast("array<struct<id:bigint,y:double>>").alias("out"))

    def step(s, h):
        near = F.exists(s["kept"], lambda k: (k["dbd"] == h["dbd"]) & (F.abs(k["centre"] - h["centre"]) < threshold))
        y = F.when(F.size(s["out"]) % 2 == 0, F.lit(-0.2)).otherwise(F.lit(0.2))
        more = F.struct(F.concat(s["kept"], F.array(F.struct(h["dbd"].alias("dbd"), h["centre"].alias("centre")))).alias("kept"), F.concat(s["out"], F.array(F.struct(h["id"].alias("id"), y.alias("y")))).alias("out"))
        return F.when(near, s).otherwise(more)

    rows = hits.where(F.col("cluster_dbd").isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("start", F.col("seqlet_id").alias("id"), ((F.col("start") + F.col("end")) / 2).alias("centre"), F.col("cluster_dbd").alias("dbd")))).alias("_h"))
    return rows.select(group, F.explode(F.aggregate("_h", state, step)["out"]).alias("_o")).select(group, F.col("_o.id").alias("seqlet_id"), F.col("_o.y").alias("y"))


def region_contributions(
    examples: DataFrame,
    seqlets: DataFrame,
    example_idx: int | None = None,
    region_name: str | None = None,
    zoom: tuple[int | None, int | None] = (None, None),
    least: float | None = None,
    show_unannotated: bool = False,
    threshold: float = 25,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """V3: the logo matrix (position, A, C, G, T) of a region; the stretches of its hits, with a domain or, if
    ``show_unannotated``, without; and the labels (seqlet_id, y)."""
    _need(examples, "example_idx", "contrib", "oh")
    _need(seqlets, "example_idx", "start", "end", "cluster_dbd", "attribution")
    if example_idx is None and region_name is not None:
        _need(seqlets, "region_name")
    key = F.col("example_idx") == example_idx if example_idx is not None else F.col("example_idx").isin([r[0] for r in seqlets.where(F.col("region_name") == region_name).select("example_idx").limit(1).collect()] if region_name is not None else [])
    row = examples.where(key)
    size = row.select(F.size(F.element_at("contrib", 1))).first()
    hits = region_hits(seqlets, size[0] if size else 1 << 31, example_idx, region_name, zoom, least)
    if size is None:
        raise ValueError("the region is not among the examples")
    matrix = A.transpose(A.product(F.col("contrib"), F.col("oh")))
    cells = row.select(F.posexplode(matrix).alias("position", "_v")).select("position", *(F.element_at("_v", i + 1).alias(b) for i, b in enumerate(A.BASES)))
    if zoom[0] is not None and zoom[1] is not None:
        cells = cells.where((F.col("position") >= zoom[0]) & (F.col("position") < zoom[1])).withColumn("position", F.col("position") - zoom[0])
    shown = hits if show_unannotated else hits.where(F.col("cluster_dbd").isNotNull())
    return cells, shown, dedupe_labels(hits, threshold)


def dbd_heatmap(obs: DataFrame, row: str = "cell_type", column: str = "cluster_dbd") -> tuple[DataFrame, DataFrame]:
    """Long counts and the order of the columns; "nan" is no domain."""
    _need(obs, row, column)
    known = obs.where(F.col(column) != "nan")
    return R.crosstab(known, row, column), R.column_order(known, row, column)


def dbd_topic_heatmap(topic: DataFrame, obs: DataFrame, least: float = 0.005) -> DataFrame:
    """V5: domain by topic, with the places of both in order of activity."""
    names = R.first_by(obs.withColumnRenamed("cluster_dbd", "dbd"), "leiden", "dbd", "seqlet_id").withColumnRenamed("leiden", "cluster")
    table = T.dbd_topic(topic, names)
    active = T.topic_activity(table, least).withColumn("topic_at", F.row_number().over(Window.orderBy(F.desc("n_active"), "topic")) - 1)
    best = T.best_topic(table).join(active.select("topic", "topic_at"), "topic").select("dbd", F.col("topic_at").alias("best_at"))
    return table.join(active, "topic").join(best, "dbd").orderBy("best_at", "dbd", "topic_at")


def region_topic_tsne(region_topic_wide: DataFrame, k: int, show: list[int] | None = None) -> DataFrame:
    """Points of regions and scaled topic values in long form, ordered by intensity."""
    from tessera.operators.cluster import embed

    names = [f"Topic_{t}" for t in range(1, k + 1)]
    points = embed(region_topic_wide.select("region_id", F.array(*names).alias("v")), "region_id", "v")
    scaled = R.minmax(region_topic_wide, names)
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("topic"), F.col(f"Topic_{t}_scaled").alias("value")) for t in show or range(1, k + 1))))
    return points.join(scaled.select("region_id", pairs.alias("_p")).select("region_id", "_p.*"), "region_id").orderBy("topic", "value", "region_id")


def dbd_logos(patterns: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """V7: one pattern per domain, and the grid that holds them."""
    from math import ceil, sqrt

    best = representatives(patterns)
    n = best.count()
    if not n:
        raise ValueError("no pattern has a domain")
    columns = ceil(sqrt(n))
    return logo(patterns.join(best.select("leiden"), "leiden", "left_semi")).orderBy("dbd"), (ceil(n / columns), columns)


def dbd_cluster_logos(patterns: DataFrame, dbd: str, by: str = "ic") -> DataFrame:
    """V8."""
    own = patterns.where(F.col("dbd") == dbd)
    if own.isEmpty():
        raise ValueError(f"no pattern of {dbd}")
    return sort_patterns(logo(own), by)
