"""Topics of clusters per region: Gibbs sampling, model comparison, and matrices by topic."""

from __future__ import annotations

import zlib
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.shared import drop, stored

K_VALUES = (10, 15, 20, 25, 30, 35, 40, 50)


def count_table(obs: DataFrame, filter_unknown: bool = True) -> DataFrame:
    """(region_id, cluster, n) from distinct (region, start, end, cluster[, domain]) rows."""
    need = {"leiden", "example_idx", "start", "end"} - set(obs.columns)
    if need:
        raise ValueError(f"topic modelling needs the columns {sorted(need)}")
    rows = obs.select(F.col("example_idx").cast("string").alias("region_id"), "start", "end", F.col("leiden").alias("cluster"), *(["cluster_dbd"] if "cluster_dbd" in obs.columns else [])).distinct()
    if filter_unknown and "cluster_dbd" in obs.columns:
        rows = rows.where(F.col("cluster_dbd").isNotNull() & (F.col("cluster_dbd") != "nan"))
    return rows.where(F.col("region_id").isNotNull() & F.col("cluster").isNotNull()).groupBy("region_id", "cluster").agg(F.count("*").alias("n"))


#: Tokens that are drawn side by side.
SIDE = 512
#: Tokens of a shard, shards at least, and sweeps over a shard between two merges of the counts of words.
SHARD_TOKENS, SHARDS, MERGE = 200_000, 4, 10


def gibbs(docs: np.ndarray, words: np.ndarray, z: np.ndarray, n_docs: int, wt: np.ndarray, alpha: float, eta: float, sweeps: int, rng: np.random.Generator) -> np.ndarray:
    """Collapsed Gibbs sampling (Griffiths & Steyvers 2004) of the topics ``z`` of tokens (docs[i], words[i]), which it returns.
    ``wt``: counts of (word, topic), those of other shards included; a copy is kept up to date.

    Up to ``SIDE`` tokens, each of another document, are drawn side by side: a document's counts are those of the plain
    sampler, those of words lack the changes of the same batch, and of other shards since the last merge (Newman et al. 2009).
    """
    n_words, k = wt.shape
    order = np.argsort(docs, kind="stable")
    place = np.empty(len(docs), np.int64)
    place[order] = np.arange(len(docs)) - np.searchsorted(docs[order], docs[order])
    order = np.lexsort((docs, place))
    docs, words, place, z, back = docs[order], words[order], place[order], z[order].astype(np.int64), np.argsort(order)
    edges = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
    batches = [(lo, min(lo + SIDE, b)) for a, b in zip(edges[:-1], edges[1:], strict=True) for lo in range(a, b, SIDE)]
    dt, wt = np.zeros((n_docs, k)), wt.astype(float)
    np.add.at(dt, (docs, z), 1)
    t = wt.sum(0)
    for _ in range(sweeps if k > 1 else 0):
        draws = rng.random(len(docs))
        for a, b in batches:
            d, w, old, row = docs[a:b], words[a:b], z[a:b].copy(), np.arange(b - a)
            own, word, total = dt[d] + alpha, wt[w] + eta, np.repeat(t[None] + n_words * eta, b - a, 0)
            for x in (own, word, total):
                x[row, old] -= 1
            p = (own * word / total).cumsum(1)
            new = np.minimum((p < draws[a:b, None] * p[:, -1:]).sum(1), k - 1)
            z[a:b] = new
            dt[d, old] -= 1
            dt[d, new] += 1
            np.add.at(wt, (w, old), -1)
            np.add.at(wt, (w, new), 1)
            t += np.bincount(new, minlength=k) - np.bincount(old, minlength=k)
    return z[back]


def plain_gibbs(docs: np.ndarray, words: np.ndarray, n_docs: int, n_words: int, k: int, alpha: float, eta: float, n_iter: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (document, topic) and (topic, word) by one sampler over all tokens."""
    rng = np.random.default_rng(seed)
    z, wt = rng.integers(0, k, len(docs)), np.zeros((n_words, k))
    np.add.at(wt, (words, z), 1)
    z = gibbs(docs, words, z, n_docs, wt, alpha, eta, n_iter, rng)
    dt, tw = np.zeros((n_docs, k)), np.zeros((k, n_words))
    np.add.at(dt, (docs, z), 1)
    np.add.at(tw, (z, words), 1)
    return dt, tw


#: Numbers of a chunk of cells that are at work together, and tokens of a cell that are drawn one by one.
WORK, MANY = 1 << 16, 255


class Cells:
    """A shard's cells, (region, cluster) pairs with the tokens that they hold, in chunks of whole regions.

    Of a chunk: its regions, from ``first`` on; region and word of its cells, those with the most tokens first but for the ones
    with over ``MANY``, which come last; how many cells have more than j tokens, for each j; and the ways back to regions and words."""

    def __init__(self, docs: np.ndarray, words: np.ndarray, n: np.ndarray, k: int):
        bounds = np.flatnonzero(np.diff(docs, prepend=-1, append=-1))  # of each region's cells
        self.chunks, at = [], 0
        while at < len(bounds) - 1:
            to = max(int(np.searchsorted(bounds, bounds[at] + max(WORK // k, 1), "right")) - 1, at + 1)
            d, w, m = (x[bounds[at] : bounds[to]] for x in (docs, words, n))
            order = np.argsort(np.where(m > MANY, 0, -m), kind="stable")
            few = int((m <= MANY).sum())
            more = [int(x) for x in np.searchsorted(-m[order[:few]], -np.arange(m[order[0]] if few else 0), "left")]
            by_word = np.argsort(w[order], kind="stable")
            kinds, starts = np.unique(w[order][by_word], return_index=True)
            self.chunks.append((int(d[0]), d[order] - d[0], w[order], m[order[few:]], more, np.argsort(order), bounds[at:to] - bounds[at], by_word, kinds, starts))
            at = to


def _draw(p: np.ndarray, many: np.ndarray, more: list[int], rng: np.random.Generator) -> np.ndarray:
    """Tokens by (topic, cell): multinomial draws of each cell under the running sums ``p`` of its topics' weights."""
    few = p.shape[1] - len(many)
    out, upto, hit = np.empty(p.shape, np.int32), np.zeros((len(p), few), np.uint8), np.empty((len(p), few), bool)
    for m in more:
        u = (1 - rng.random(m, np.float32)) * p[-1, :m]
        upto[:, :m] += np.greater_equal(p[:, :m], u, out=hit[:, :m]).view(np.uint8)
    out[0, :few] = upto[0]
    np.subtract(upto[1:], upto[:-1], out=out[1:, :few])
    if len(many):
        weights = np.diff(p[:, few:].astype(float), axis=0, prepend=0)
        out[:, few:] = rng.multinomial(many, (weights / weights.sum(0)).T).T
    return out


def cell_gibbs(cells: Cells, dt: np.ndarray, own: np.ndarray, wt: np.ndarray, alpha: float, eta: float, sweeps: int, rng: np.random.Generator) -> None:
    """Gibbs sampling of topics by cells: ``dt``, counts of (region, topic), and ``own``, of (word, topic), of a shard are brought
    on by some sweeps.  ``wt``: counts of (word, topic), those of other shards included.

    A sweep draws each topic's clusters and each region's topics from their Dirichlet posteriors; given these, tokens are
    independent, so all tokens of a cell are one multinomial draw.  It leaves the same posterior as the collapsed sampler, and a
    sweep's cost follows the cells, not the tokens.  Weights are in single precision.
    """
    others = wt - own
    for _ in range(sweeps if dt.shape[1] > 1 else 0):
        phi = rng.standard_gamma(others + own + eta)
        phi = np.ascontiguousarray((phi / np.maximum(phi.sum(0), 1e-300)).T, np.float32)
        phi /= np.maximum(phi.max(), np.float32(1e-30))
        own[:] = 0
        for first, docs, words, many, more, back, bounds, by_word, kinds, starts in cells.chunks:
            here = slice(first, first + len(bounds))
            theta = rng.standard_gamma(dt[here] + alpha)
            theta = np.ascontiguousarray((theta / np.maximum(theta.max(1, keepdims=True), 1e-300)).T, np.float32)
            p = theta.take(docs, 1)
            p *= phi.take(words, 1)
            p += np.float32(1e-37)  # no cell is without weight
            drawn = _draw(np.cumsum(p, 0, out=p), many, more, rng)
            dt[here] = np.add.reduceat(drawn.take(back, 1), bounds, 1).T
            own[kinds] += np.add.reduceat(drawn.take(by_word, 1), starts, 1).T


def log_likelihood(dt: np.ndarray, tw: np.ndarray, alpha: float, eta: float, mode: str = "exact") -> float:
    """M12.  ``exact``: log p(words, topics).  ``reference``: as ``exact``, but of the terms of the cells only the last one
    counts, and the rows' terms only from the last row with a count on; results can so be compared with those of packages
    that compute it this way."""
    if mode not in ("exact", "reference"):
        raise ValueError(f"no mode {mode!r}")

    terms = [(_row_terms(row, prior), row.shape[0]) for rows, prior in ((tw, eta), (dt, alpha)) for row in rows]
    cut = len(tw)
    return _total(terms[:cut], eta, mode) + _total(terms[cut:], alpha, mode)


def _row_terms(row: np.ndarray, prior: float) -> tuple[float, float | None]:
    """Of a row of counts: its term of the log-likelihood, and that by its last cell above zero, None if it has none."""
    n, cells = len(row), row[row > 0]
    end = lgamma(float(row.sum()) + n * prior)
    exact = sum(lgamma(float(c) + prior) - lgamma(prior) for c in cells) + lgamma(n * prior) - end
    return exact, (lgamma(float(cells[-1]) + prior) - end if len(cells) else None)


def _total(terms: list, prior: float, mode: str) -> float:
    """Rows' terms, in their order, as one number."""
    if mode == "exact" or not terms:
        return sum(t[0] for t, _ in terms)
    filled = [i for i, (t, _) in enumerate(terms) if t[1] is not None]
    n = terms[0][1] if terms else 0
    constant = n * lgamma(prior) - lgamma(n * prior) if n else 0.0
    after = len(terms) - (filled[-1] + 1 if filled else 0)
    return (terms[filled[-1]][0][1] if filled else 0.0) - after * lgamma(n * prior) - len(terms) * constant


FITS = "k int, kind string, row string, topic int, prob double, log_likelihood double"
SHARD = "shard int, regions array<string>, docs binary, words binary, n binary"


def _shards(counts: DataFrame, names: list[str], shards: int) -> DataFrame:
    """Each shard's regions in order, and of each of its cells the place of the region and of the cluster, and its tokens."""
    shared = counts.sparkSession.sparkContext.broadcast({c: i for i, c in enumerate(names)})

    def pack(table: pa.Table) -> pa.Table:
        number = shared.value
        regions, docs = np.unique(np.array(table["region_id"].to_pylist(), object).astype(str), return_inverse=True)
        words = np.array([number[c] for c in table["cluster"].to_pylist()], np.int64)
        order = np.lexsort((words, docs))
        rows = [table["shard"][0].as_py(), regions.tolist(), *(x[order].astype("<i4").tobytes() for x in (docs, words, table["n"].to_numpy()))]
        return pa.table([pa.array([x], kind) for x, kind in zip(rows, (pa.int32(), pa.list_(pa.string()), *[pa.binary()] * 3), strict=True)], [c.split()[0] for c in SHARD.split(", ")])

    dealt = counts.withColumn("shard", F.pmod(F.xxhash64("region_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(pack, SHARD)


def fit_topics(counts: DataFrame, ks: list[int] | None = None, alpha: float = 50.0, eta: float = 0.1, n_iter: int = 150, seed: int = 123, mode: str = "exact", shard_tokens: int = SHARD_TOKENS, shards: int = SHARDS, merge: int = MERGE) -> DataFrame:
    """Topics of regions and clusters by Gibbs sampling (``cell_gibbs``), for each number of topics, with the likelihood.

    Regions are dealt to shards of about ``shard_tokens`` tokens, ``shards`` at least.  A task samples a shard for one number of
    topics; after ``merge`` sweeps the counts of clusters by topic, which are all that shards share, are added up and sent out
    again (Newman et al. 2009).  It is one method at every size; a shard's draws follow from the seed, its number and the turn.
    All numbers of topics go on side by side, a table per turn.  Clusters by topic, whose number doesn't grow with the regions,
    reach the driver.
    """
    ks, spark = sorted(set(ks or K_VALUES)), counts.sparkSession
    kept, kept_at = stored(counts.where("n > 0").select(F.col("region_id").cast("string").alias("region_id"), F.col("cluster").cast("string").alias("cluster"), F.col("n").cast("long").alias("n")), "topic-counts")
    names = sorted(r[0] for r in kept.select("cluster").distinct().collect())
    tokens = kept.agg(F.sum("n")).first()[0] or 0
    if not tokens:
        return spark.createDataFrame([], FITS)
    parts = max(shards, -(-tokens // shard_tokens))
    fixed, fixed_at = stored(_shards(kept, names, parts), "topic-shards")
    models = fixed.select("shard").crossJoin(F.broadcast(spark.createDataFrame([(k,) for k in ks], "k int")))
    state, state_at = models.withColumns({"z": F.lit(None).cast("binary"), "own": F.lit(None).cast("array<long>")}), None
    total: dict[int, np.ndarray] = {}
    turns = [min(merge, n_iter - at) for at in range(0, n_iter, merge)]
    for turn, sweeps in enumerate([0, *turns]):
        step, step_at = stored(_turn(fixed, state, len(names), total, alpha, eta, sweeps, seed + 1000 * turn), "topic-turn")
        if state_at:
            drop(spark, state_at)
        state, state_at = step, step_at
        total = {k: np.zeros((len(names), k)) for k in ks}
        for k, cell, n in step.select("k", F.posexplode("own").alias("cell", "n")).where("n > 0").groupBy("k", "cell").agg(F.sum("n")).collect():  # clusters times topics
            total[k].reshape(-1)[cell] = n
    regions, regions_at = stored(_regions(fixed, state, alpha), "topic-regions")
    found = regions.groupBy("k").agg(F.sum("exact").alias("exact"), F.max_by("last", "row").alias("last"), F.count("*").alias("n")).collect()  # a row per model
    likelihood, rows = {}, []
    for k, exact, last, n in found:
        prior = alpha / k
        own = exact if mode == "exact" else last - n * (k * lgamma(prior) - lgamma(k * prior))
        likelihood[k] = log_likelihood(np.zeros((0, k)), total[k].T, prior, eta, mode) + own
        share = (total[k] + eta) / (total[k] + eta).sum(0)
        rows += [(k, "cluster", c, t + 1, float(share[i, t]), likelihood[k]) for i, c in enumerate(names) for t in range(k)]
    drop(spark, kept_at, fixed_at, state_at)
    known = spark.createDataFrame(list(likelihood.items()), "k int, log_likelihood double")
    by_region = regions.join(F.broadcast(known), "k").select("k", F.lit("region").alias("kind"), "row", F.posexplode("probs").alias("topic", "prob"), "log_likelihood").withColumn("topic", F.col("topic") + 1)
    return by_region.select(*(c.split()[0] for c in FITS.split(", "))).unionByName(spark.createDataFrame(rows, FITS))


def _places(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<i4").astype(np.int64)


def _turn(fixed: DataFrame, state: DataFrame, n_words: int, total: dict[int, np.ndarray], alpha: float, eta: float, sweeps: int, seed: int) -> DataFrame:
    """(k, shard, z, own): each shard's counts of tokens by region and topic after some sweeps, and by cluster and topic."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                k, (docs, words, n) = row["k"], (_places(row[c]) for c in ("docs", "words", "n"))
                rng = np.random.default_rng([seed, k, row["shard"]])
                if row["z"] is None:
                    dt, own = np.zeros((len(row["regions"]), k), np.int64), np.zeros((n_words, k), np.int64)
                    for lo in range(0, len(n), WORK):
                        part = slice(lo, lo + WORK)
                        drawn = rng.multinomial(n[part], np.full(k, 1 / k))
                        np.add.at(dt, docs[part], drawn)
                        np.add.at(own, words[part], drawn)
                else:
                    dt, own = _places(zlib.decompress(row["z"])).reshape(-1, k), np.array(row["own"], np.int64).reshape(-1, k)
                    cell_gibbs(Cells(docs, words, n, k), dt, own, total[k], alpha / k, eta, sweeps, rng)
                columns = [pa.array([k], pa.int32()), pa.array([row["shard"]], pa.int32()), pa.array([zlib.compress(dt.astype("<i4").tobytes(), 1)]), pa.array([own.reshape(-1).tolist()], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["k", "shard", "z", "own"])

    # A row is a shard of one model: the sampler costs far more than moving it, and small rows would be gathered in one task.
    n = int(fixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = state.join(fixed, "shard").select("k", "shard", "z", "own", "regions", "docs", "words", "n").repartition(n, "k", "shard")
    return met.mapInArrow(run, "k int, shard int, z binary, own array<long>")


def _regions(fixed: DataFrame, state: DataFrame, alpha: float) -> DataFrame:
    """(k, row, probs, exact, last): each region's topics and its terms of the likelihood."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                k = row["k"]
                counts = _places(zlib.decompress(row["z"])).reshape(-1, k)
                terms = [_row_terms(c, alpha / k) for c in counts]
                probs = (counts + alpha / k) / (counts + alpha / k).sum(1, keepdims=True)
                columns = [pa.array([k] * len(counts), pa.int32()), pa.array(row["regions"]), pa.array(probs.tolist(), pa.list_(pa.float64())), pa.array([t[0] for t in terms]), pa.array([t[1] for t in terms], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["k", "row", "probs", "exact", "last"])

    met = state.join(fixed, "shard").select("k", "shard", "z", "regions")
    return met.mapInArrow(run, "k int, row string, probs array<double>, exact double, last double")


def log_gamma(x: Column) -> Column:
    """not among Spark's functions."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lgamma, na_action="ignore").astype(float)

    return F.pandas_udf(run, "double")(x)


def evaluate(fits: DataFrame) -> DataFrame:
    """(k, log_likelihood)."""
    return fits.groupBy("k").agg(F.first("log_likelihood").alias("log_likelihood"))


def region_topic(fits: DataFrame, k: int) -> DataFrame:
    return fits.where((F.col("k") == k) & (F.col("kind") == "region")).select(F.col("row").alias("region_id"), "topic", "prob")


def cluster_topic(fits: DataFrame, k: int) -> DataFrame:
    """M13."""
    return fits.where((F.col("k") == k) & (F.col("kind") == "cluster")).select(F.col("row").alias("cluster"), "topic", "prob")


def wide(long: DataFrame, key: str, k: int) -> DataFrame:
    """Columns Topic_1 .. Topic_k."""
    return long.groupBy(key).agg(*(F.max(F.when(F.col("topic") == t, F.col("prob"))).alias(f"Topic_{t}") for t in range(1, k + 1)))


def dbd_topic(topic: DataFrame, cluster_dbd: DataFrame, key: str = "cluster") -> DataFrame:
    """Unweighted mean over the clusters of a domain; clusters without one are left out."""
    return topic.join(cluster_dbd, key).where(F.col("dbd").isNotNull()).groupBy("dbd", "topic").agg(F.avg("prob").alias("prob"))


def topic_activity(dbd: DataFrame, least: float = 0.005) -> DataFrame:
    """Topics by the number of domains above ``least``."""
    return dbd.groupBy("topic").agg(F.count_if(F.col("prob") > least).alias("n_active")).orderBy(F.desc("n_active"), "topic")


def best_topic(dbd: DataFrame) -> DataFrame:
    """The topic of each domain with the highest probability, the first of equals."""
    return dbd.groupBy("dbd").agg(F.max_by("topic", F.struct(F.col("prob"), -F.col("topic"))).alias("topic"))
