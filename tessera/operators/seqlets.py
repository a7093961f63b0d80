"""Seqlet calling against a background that is shared by all examples.

The background (extremes and counts of span sums per length, and a histogram of 1000 bins on either side of zero) is
aggregated by the engine; it has at most 2 x 22 x 1000 rows.  The greedy calls of an example depend on nothing else, so they
run row by row without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators.relational import in_order
from tessera.shared import materialise

BINS = 999
SEQLETS = "example_idx long, start int, end int, attribution double, p_value double"


def spans(examples: DataFrame, shortest: int = 4, longest: int = 25, values: str = "x") -> DataFrame:
    """Sums of all spans: (example_idx, len, start, s)."""
    x = F.col(values)
    zero = F.element_at(x, 1) * 0
    sums = F.aggregate(x, F.array(zero), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
    lens = F.sequence(F.lit(shortest), F.least(F.lit(longest), F.size(x)))
    rows = examples.where(F.size(x) >= shortest).select("example_idx", sums.alias("_c"), lens.alias("_lens")).select("example_idx", "_c", F.explode("_lens").alias("len"))
    starts = F.sequence(F.lit(0), F.size("_c") - 1 - F.col("len"))
    sliding = F.transform(starts, lambda k: F.get("_c", k + F.col("len")) - F.get("_c", k))
    return rows.select("example_idx", "len", F.posexplode(sliding).alias("start", "s"))


def background(found: DataFrame) -> DataFrame:
    """A1: per length, the extremes from zero and the counts on either side; zero counts as not positive."""
    s = F.col("s")
    return found.groupBy("len").agg(
        F.coalesce(F.max(F.when(s > 0, s)), F.max(s * 0)).alias("xmax"),
        F.coalesce(F.min(F.when(s <= 0, s)), F.min(s * 0)).alias("xmin"),
        F.count_if(s > 0).alias("n_pos"),
        F.count_if(s <= 0).alias("n_neg"),
    )


def binned(found: DataFrame, extremes: DataFrame, integer: bool = False) -> DataFrame:
    """A2: spans with positive, their bin of the side, and the extremes and counts of their length."""
    side = F.when(F.col("s") > 0, F.col("xmax")).otherwise(F.col("xmin"))
    # Bins are quotients of numbers with one sign; a side whose extreme is zero has bin 0 only.
    scaled = F.expr("(999 * s) div CASE WHEN s > 0 THEN xmax ELSE nullif(xmin, 0) END") if integer else F.floor(F.try_divide(BINS * F.col("s"), side))
    return found.join(F.broadcast(extremes), "len").withColumns({"positive": F.col("s") > 0, "bin": F.coalesce(scaled, F.lit(0)).cast("int")})


def histogram(found: DataFrame, extremes: DataFrame, integer: bool = False) -> DataFrame:
    """Counts by (len, positive, bin) and p, the share of the side in higher bins."""
    sides = binned(found, extremes, integer).select("len", "positive", "bin", F.when(F.col("s") > 0, F.col("n_pos")).otherwise(F.col("n_neg")).alias("side_n"))
    counts = sides.groupBy("len", "positive", "bin").agg(F.count("*").alias("n"), F.first("side_n").alias("side_n"))
    running = F.sum("n").over(Window.partitionBy("len", "positive").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("p", 1 - running / F.col("side_n")).drop("side_n")


@dataclass
class Background:
    """The tables of the background as arrays: rows are lengths, columns bins."""

    shortest: int
    longest: int
    xmax: np.ndarray
    xmin: np.ndarray
    p: np.ndarray  # (2, lengths, bins): not positive, positive

    @classmethod
    def of(cls, examples: DataFrame, shortest: int = 4, longest: int = 25) -> Background:
        found = spans(examples, shortest, longest)
        extremes = background(found)
        n = longest + 1
        out = cls(shortest, longest, np.zeros(n), np.zeros(n), np.ones((2, n, BINS + 1)))
        for r in extremes.collect():  # one row per length
            out.xmax[r["len"]], out.xmin[r["len"]] = r["xmax"], r["xmin"]
        seen = np.zeros(out.p.shape, bool)
        for r in histogram(found, extremes).collect():  # 1000 bins per side and length at most
            at = int(r["positive"]), r["len"], r["bin"]
            out.p[at], seen[at] = r["p"], True
        # A bin that the background has no value in has the share of the bin before it.
        last = np.maximum.accumulate(np.where(seen, np.arange(BINS + 1), 0), axis=2)
        out.p = np.take_along_axis(out.p, last, 2)
        return out


def p_matrices(x: np.ndarray, bg: Background, threshold: float) -> np.ndarray:
    """P of each (example, length, start) of examples of one length; a span whose shorter span at the same start fails has p
    of at least the threshold."""
    rows, n = x.shape
    sums = np.concatenate([np.zeros((rows, 1)), np.cumsum(x, 1)], 1)
    out = np.ones((rows, bg.longest + 1, n))
    failed = np.zeros((rows, n), bool)
    for j in range(bg.shortest, min(bg.longest, n) + 1):
        s = sums[:, j:] - sums[:, :-j]
        top = np.where(s > 0, bg.xmax[j], bg.xmin[j])
        bins = np.clip(np.floor(np.divide(BINS * s, top, out=np.zeros_like(s), where=top != 0)), 0, BINS).astype(int)
        p = bg.p[(s > 0).astype(int), j, bins]
        p = np.where((s <= 0) & (bg.xmin[j] == 0), 1.0, p)
        here = failed[:, : s.shape[1]]
        out[:, j, : s.shape[1]] = np.where(here, np.maximum(threshold, 0), p)
        failed[:, : s.shape[1]] = here | (p >= threshold)
    return out


def p_matrix(x: np.ndarray, bg: Background, threshold: float) -> np.ndarray:
    return p_matrices(x[None], bg, threshold)[0]


def call_one(x: np.ndarray, bg: Background, threshold: float, flank: int, p: np.ndarray | None = None) -> list[tuple[int, int, float, float]]:
    """M1: the calls of one example: from long to short spans, the most significant first.

    A span is taken if the spans one position right of it, each one shorter than the last, are significant too; the starts
    inside a span taken are closed.  ``p``: the example's ``p_matrix``, if it is known; it is overwritten.
    """
    n, out = len(x), []
    if n < bg.shortest:
        return out
    sums = np.concatenate([[0.0], np.cumsum(x)])
    p = p_matrix(x, bg, threshold) if p is None else p
    some = (p < threshold).any(1)
    for j in range(min(bg.longest, n), bg.shortest - 1, -1):
        while some[j]:
            k = int(np.argmin(p[j]))
            value = p[j, k]
            p[j, k] = 1
            if value >= threshold:
                break
            steps = np.arange(j - bg.shortest)
            at = k + steps + 1
            if len(at) and (at >= n).any() or len(at) and (p[j - steps, np.minimum(at, n - 1)] >= threshold).any():
                continue
            p[:, k : min(k + j, n - 1)] = 1
            stop, start = min(k + j + flank, n - 1), max(k - flank, 0)
            out.append((start, stop, float(sums[stop] - sums[start]), float(value)))
    return out


#: Spans whose p-values are looked up together.
TOGETHER = 1 << 20


def call_all(values: list[np.ndarray], bg: Background, threshold: float, flank: int) -> list[list[tuple[int, int, float, float]]]:
    """``call_one`` of each example, with the p-values of examples of one length at once."""
    found: list[list] = [[] for _ in values]
    lengths = np.array([len(x) for x in values])
    for n in np.unique(lengths[lengths >= bg.shortest]).tolist():
        same = np.flatnonzero(lengths == n).tolist()
        step = max(TOGETHER // (n * (bg.longest + 1)), 1)
        for lo in range(0, len(same), step):
            part = same[lo : lo + step]
            for i, p in zip(part, p_matrices(np.stack([values[i] for i in part]), bg, threshold), strict=True):
                found[i] = call_one(values[i], bg, threshold, flank, p)
    return found


def _spread(examples: DataFrame) -> DataFrame:
    """Examples dealt out evenly: what is done with one costs far more than moving it, and a small file is one task."""
    return examples.select("example_idx", "x").repartition(int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions")), "example_idx")


def call_seqlets(examples: DataFrame, threshold: float = 0.01, shortest: int = 4, longest: int = 25, flank: int = 0, background_table: Background | None = None) -> DataFrame:
    """M1: calls on (example_idx, x).  The background is that of all examples in the call, or one frozen before."""
    bg = background_table or Background.of(_spread(examples), shortest, longest)

    def run(batches):
        for pdf in batches:
            calls = call_all([np.asarray(x, float) for x in pdf["x"]], bg, threshold, flank)
            rows = [(i, *c) for i, found in zip(pdf["example_idx"], calls, strict=True) for c in found]
            yield pd.DataFrame(rows, columns=["example_idx", "start", "end", "attribution", "p_value"])

    dealt = examples.select("example_idx", "x") if examples.isStreaming else _spread(examples)
    return dealt.mapInPandas(run, SEQLETS)


def with_ids(seqlets: DataFrame) -> DataFrame:
    """Numbered by ascending p, then example and place; see ``relational.in_order``."""
    numbered = in_order(seqlets.sort("p_value", "example_idx", "start", "end"))
    return numbered.select(F.col("position").alias("seqlet_id"), *seqlets.columns)


def cut_matrices(found: DataFrame, examples: DataFrame) -> DataFrame:
    """Each seqlet's normalised, sign-corrected matrix and its one-hot, cut out of its example."""
    cut = found.join(examples.select("example_idx", "contrib", "oh"), "example_idx")
    part = A.slice_columns(F.col("contrib"), F.col("start"), F.col("end"))
    hot = A.slice_columns(F.col("oh"), F.col("start"), F.col("end"))
    return cut.withColumns({"_x": A.normalise(part), "seqlet_oh": hot}).withColumn("seqlet_matrix", A.sign_correct(F.col("_x"), F.col("seqlet_oh"))).drop("_x", "contrib", "oh")


def extract_seqlets(examples: DataFrame, threshold: float = 0.05, flank: int = 3) -> DataFrame:
    """M2: projects, calls, and cuts each seqlet's matrix."""
    x = examples.select("example_idx", A.project(F.col("contrib"), F.col("oh")).alias("x"))
    return cut_matrices(with_ids(call_seqlets(x, threshold, flank=flank)), examples)


def span_p_values(examples: DataFrame, threshold: float, shortest: int = 4, longest: int = 25) -> DataFrame:
    """(example_idx, len, start, p) of every span of (example_idx, x), under the background of all examples.

    Examples, not their spans, are dealt by id; an example's spans arise, meet the histogram (22,000 rows on either side at
    most, broadcast) and are capped where the example lies.  A span whose shorter span at the same start fails has p of the
    threshold: any shorter one, as what is capped fails too.
    """
    dealt = examples.select("example_idx", "x").repartition("example_idx")
    extremes = background(spans(examples, shortest, longest))
    extremes = materialise(extremes, "span-extremes")  # one row per length
    shares = materialise(histogram(spans(examples, shortest, longest), extremes).select("len", "positive", "bin", "p"), "span-shares")
    met = binned(spans(dealt, shortest, longest), extremes).join(F.broadcast(shares), ["len", "positive", "bin"])
    p = F.when(~F.col("positive") & (F.col("xmin") == 0), 1.0).otherwise(F.col("p"))
    shorter = Window.partitionBy("example_idx", "start").orderBy("len").rowsBetween(Window.unboundedPreceding, -1)
    capped = F.when(F.max("p").over(shorter) >= threshold, F.lit(float(max(threshold, 0)))).otherwise(F.col("p"))
    return met.select("example_idx", "len", "start", p.alias("p")).select("example_idx", "len", "start", capped.alias("p"))


def with_example_arrays(seqlets: DataFrame, examples: DataFrame) -> DataFrame:
    """The arrays of its example beside each seqlet; they are stored once per example and joined on demand."""
    return seqlets.join(examples.select("example_idx", F.col("oh").alias("example_oh"), F.col("contrib").alias("example_contrib")), "example_idx", "left")
