"""Consensus patterns: the seqlets of a cluster, aligned to their most central member."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators.align import SCORES, Columns, Targets, binned, score
from tessera.operators.bounds import SLACK, Group, lower_bounds
from tessera.operators.relational import mode_smallest
from tessera.shared import materialise

ALIGNED = "leiden string, seqlet_id long, offset int, is_revcomp boolean, is_root boolean"
INSTANCES = ["leiden", "seqlet_id", "start", "end", "is_revcomp", "is_root", "seq_instance", "contrib", "hypothetical"]

#: Seqlets of a cluster that a task asks for at once; all seqlets of the cluster pass by it.
BLOCK = 2048
#: Parts for each core, if a part has enough seqlets then.
PARTS_A_CORE, SMALL_BLOCK = 6, 128
#: Targets that are laid out together as they pass; what a query needs for them is computed anew for each group.
PASSING = 1 << 16
#: Targets of exact alignments at a time.
EXACT = 2048
#: Seqlets of a cluster, by their bounds, that are aligned first, so that the others have something to be compared with.
FIRST = 64


def _matrices(rows: list) -> list[np.ndarray]:
    return [np.array(m, float) for m in rows]


PACKED = "leiden string, part int, ids binary, lengths binary, columns binary"


def _pack(batches):
    """Rows sorted by (leiden, part): one row for each part: ids, lengths and columns of its seqlets."""
    key, ids, columns = None, [], []

    def packed():
        lengths = np.array([len(c) for c in columns], np.int64)
        values = [key[0], key[1], np.array(ids, np.int64).tobytes(), lengths.tobytes(), np.concatenate(columns).tobytes()]
        kinds = [pa.string(), pa.int32(), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in PACKED.split(", ")])

    for batch in batches:
        for row in batch.to_pylist():
            if (row["leiden"], row["part"]) != key:
                if ids:
                    yield packed()
                key, ids, columns = (row["leiden"], row["part"]), [], []
            ids.append(row["seqlet_id"])
            columns.append(np.array(row["seqlet_matrix"], float).T)
    if ids:
        yield packed()


class _Seqlets:
    """Rows of ``_pack`` as arrays; of those asked for, what is known of their null: ``low`` and ``high``, ``counts``."""

    def __init__(self, rows: list[dict]):
        read = lambda c, kind: np.concatenate([np.frombuffer(r[c], kind) for r in rows])
        self.ids, self.lengths = read("ids", np.int64), read("lengths", np.int64)
        self.columns = read("columns", float).reshape(-1, 4)
        self.begins = np.cumsum(self.lengths) - self.lengths
        n = len(self.columns)
        known = lambda c: rows[0].get(c) is not None
        self.low = read("low", float) if known("low") else np.full(n, np.inf)
        self.high = read("high", float) if known("high") else np.full(n, -np.inf)
        self.counts = read("counts", np.int64).reshape(n, -1) if known("counts") else np.zeros((n, SCORES + 1), np.int64)

    def matrices(self) -> list[np.ndarray]:
        return [self.columns[b : b + m].T for b, m in zip(self.begins.tolist(), self.lengths.tolist(), strict=True)]

    def with_nulls(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        parts = zip(self.begins.tolist(), (self.begins + self.lengths).tolist(), strict=True)
        return [(self.columns[b:e].T, self.low[b:e], self.high[b:e], self.counts[b:e]) for b, e in parts]


def _passes(step, result, passing):
    """An Arrow kernel over packed rows sorted by (leiden, part, asked first): the seqlets that a part asks for are held, and
    its targets pass by in groups of some ``passing``: ``step(asked, targets, sums)`` sees each group, ``result`` gives the rows."""

    def run(batches):
        part, asked, held, waiting, sums = None, [], None, [], []

        def flush():
            nonlocal held
            if waiting and asked:  # a part may be empty
                held = held or _Seqlets(asked)
                step(held, _Seqlets(waiting), sums)
            waiting.clear()

        def finish():
            flush()
            if held is not None:
                yield from result(part, held, sums)

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if (row["leiden"], row["part"]) != part:
                    yield from finish()
                    part, asked, held, sums = (row["leiden"], row["part"]), [], None, []
                (asked if row["asked"] else waiting).append(row)
                if sum(len(r["ids"]) for r in waiting) >= 8 * passing:
                    flush()
        yield from finish()

    return run


def _see_extremes(asked, targets, sums):
    low, high = Columns(targets.columns).extremes(asked.columns)
    asked.low, asked.high = np.minimum(asked.low, low), np.maximum(asked.high, high)


def _see_counts(asked, targets, sums):
    asked.counts += Columns(targets.columns).histogram(asked.columns, asked.low, asked.high)


def _see_bounds(asked, targets, sums):
    sums.append((targets.ids, lower_bounds(asked.with_nulls(), Group(targets.columns, targets.lengths))))


def _see_scores(asked, targets, sums):
    laid_out = Targets(targets.matrices())
    total = np.zeros(len(targets.ids))
    for matrix, low, high, counts in sorted(asked.with_nulls(), key=lambda q: q[0].shape[1]):
        total += score(binned(matrix, laid_out, low, high), laid_out, counts, places=False)[0]
    sums.append((targets.ids, total))


#: Seqlets of a row with nulls: one takes 8 KB or more, and Parquet's writer holds a hundred rows before it looks at their size.
PIECE = 64


def _nulls(part, asked, sums):
    """What a part asks for with what is known of its nulls, ``PIECE`` seqlets a row."""
    ends = np.append(asked.begins, len(asked.columns))
    for k in range(0, len(asked.ids), PIECE):
        one = slice(k, k + PIECE)
        own = slice(int(ends[k]), int(ends[min(k + PIECE, len(asked.ids))]))
        arrays = [asked.ids[one], asked.lengths[one], asked.columns[own], asked.low[own], asked.high[own], *([asked.counts[own]] if asked.counts.any() else [])]
        values = [pa.array([part[0]]), pa.array([part[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)]
        if len(arrays) < 6:
            values.append(pa.array([None], pa.binary()))
        yield pa.RecordBatch.from_arrays(values, [c.split()[0] for c in NULLS.split(", ")])


NULLS = PACKED + ", low binary, high binary, counts binary"


def _sums(part, asked, sums):
    ids, totals = (np.concatenate([s[k] for s in sums]) if sums else np.zeros(0, kind) for k, kind in ((0, np.int64), (1, float)))
    yield pa.RecordBatch.from_arrays([pa.array([part[0]] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(totals, pa.float64())], ["leiden", "seqlet_id", "total"])


SUMS = "leiden string, seqlet_id long, total double"


def _in_parts(seqlets: DataFrame, parts: DataFrame) -> DataFrame:
    """Packed rows of seqlets, those of a part together."""
    n = int(seqlets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = seqlets.select("leiden", "seqlet_id", "seqlet_matrix").join(F.broadcast(parts), "leiden")
    rows = rows.select("leiden", F.pmod(F.xxhash64("seqlet_id"), "_parts").cast("int").alias("part"), "seqlet_id", "seqlet_matrix")
    return rows.repartition(n, "leiden", "part").sortWithinPartitions("leiden", "part", "seqlet_id").mapInArrow(_pack, PACKED)


def _dealt(asked: DataFrame, targets: DataFrame, parts: DataFrame) -> DataFrame:
    """Each part of a cluster, and after it all targets of the cluster.  Parts are dealt in turn: the kernel costs far more than
    moving its rows, and by hash some tasks would get many."""
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    passing = targets.join(F.broadcast(parts), "leiden").withColumns({"_from": F.col("part"), "part": F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))})
    own = asked.join(F.broadcast(parts), "leiden").withColumns({"_from": F.lit(-1), "asked": F.lit(True)})
    rows = own.unionByName(passing.withColumn("asked", F.lit(False)), allowMissingColumns=True)
    rows = rows.repartitionById(n, ((F.col("_before") + F.col("part")) % n).cast("int")).drop("_before", "_parts")
    return rows.sortWithinPartitions("leiden", "part", F.desc("asked"), "_from").drop("_from")


def find_roots(seqlets: DataFrame, block: int | None = None) -> DataFrame:
    """(leiden, root_id, root_matrix, low, high, counts): of each cluster the seqlet with the lowest mean p-value as a
    target of all, the first of equals, and its null as bytes.  ``seqlets``: leiden, seqlet_id, seqlet_matrix, _size.

    Nulls of all seqlets take two passes (extremes, histograms).  A third finds for each seqlet a lower bound of its sum of
    p-values, under the nulls of all.  Then those with the lowest bounds are aligned exactly with all, and after them every
    other whose bound is no higher than the best sum: no seqlet that could be the root is left out.  All passes are in parts
    of ``block`` seqlets at most that the cluster passes by.  Sums of p-values are added part by part, and to nine digits, so that
    ties don't hang on their order."""
    spark, block = seqlets.sparkSession, block or BLOCK
    sizes = materialise(seqlets.select("leiden", "_size").distinct(), "pattern-sizes")  # a row a cluster
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    even = -(-total // (PARTS_A_CORE * spark.sparkContext.defaultParallelism))
    parts = sizes.select("leiden", F.ceil(F.col("_size") / min(block, max(even, SMALL_BLOCK))).cast("int").alias("_parts"))
    parts = parts.withColumn("_before", F.sum("_parts").over(Window.orderBy("leiden")) - F.col("_parts"))
    packed = materialise(_in_parts(seqlets, parts), "pattern-packed")
    known = packed
    for step in (_see_extremes, _see_counts):
        known = materialise(_dealt(known, packed, parts).mapInArrow(_passes(step, _nulls, PASSING), NULLS), "pattern-nulls")

    def sums(step, targets: DataFrame, passing: int, name: str) -> DataFrame:
        each = _dealt(known, targets, parts).mapInArrow(_passes(step, _sums, passing), SUMS)
        return materialise(each.groupBy("leiden", "seqlet_id").agg(F.sum("total").alias("total")), name)

    exactly = lambda ids: sums(_see_scores, _in_parts(seqlets.join(ids, ["leiden", "seqlet_id"], "left_semi"), parts), EXACT, "pattern-sums")
    bounds = sums(_see_bounds, packed, PASSING, "pattern-bounds")
    order = F.row_number().over(Window.partitionBy("leiden").orderBy("total", "seqlet_id"))
    first = exactly(bounds.withColumn("_r", order).where(F.col("_r") <= FIRST).select("leiden", "seqlet_id"))
    best = first.groupBy("leiden").agg(F.min("total").alias("_best")).join(sizes, "leiden")
    open_ = bounds.join(first, ["leiden", "seqlet_id"], "left_anti").join(F.broadcast(best), "leiden").where(F.col("total") <= F.col("_best") + SLACK * F.col("_size") + 1e-8)
    open_ = materialise(open_.select("leiden", "seqlet_id"), "pattern-open")
    if not open_.isEmpty():
        first = first.unionByName(exactly(open_))
    means = first.select("leiden", "seqlet_id", F.round("total", 9).alias("total"))
    roots = means.groupBy("leiden").agg(F.min_by("seqlet_id", F.struct("total", "seqlet_id")).alias("root_id"))
    at = roots.join(parts, "leiden").select("leiden", "root_id", F.pmod(F.xxhash64("root_id"), "_parts").cast("int").alias("part"))
    nulls = known.join(F.broadcast(at), ["leiden", "part"]).mapInArrow(_root_nulls, ROOT)
    own = seqlets.select("leiden", F.col("seqlet_id").alias("root_id"), F.col("seqlet_matrix").alias("root_matrix"))
    return own.join(F.broadcast(nulls), ["leiden", "root_id"]).select("leiden", "root_id", "root_matrix", "low", "high", "counts")


ROOT = "leiden string, root_id long, low binary, high binary, counts binary"


def _root_nulls(batches):
    """The null of a root out of its part's."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            asked = _Seqlets([row])
            if row["root_id"] not in asked.ids:
                continue
            null = asked.with_nulls()[int(np.flatnonzero(asked.ids == row["root_id"])[0])][1:]
            values = [pa.array([row["leiden"]]), pa.array([row["root_id"]], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in null)]
            yield pa.RecordBatch.from_arrays(values, [c.split()[0] for c in ROOT.split(", ")])


def _align_to_root(batches):
    """Offset and strand of each seqlet under its cluster's root, from the root's null."""
    for batch in batches:
        out, groups = [], {}
        for k, row in enumerate(batch.select(["leiden", "root_id", "seqlet_id", "seqlet_matrix"]).to_pylist()):
            groups.setdefault((row["leiden"], row["root_id"]), []).append((k, row))
        for (leiden, root_id), places in groups.items():
            first, rows = batch.slice(places[0][0], 1), [r for _, r in places]
            root = np.array(first.column("root_matrix")[0].as_py(), float)
            low, high, counts = (np.frombuffer(first.column(c)[0].as_py(), kind) for c, kind in (("low", float), ("high", float), ("counts", np.int64)))
            targets = Targets(_matrices([r["seqlet_matrix"] for r in rows]))
            _, _, offsets, _, strands = score(binned(root, targets, low, high), targets, counts.reshape(root.shape[1], -1))
            out += [(leiden, r["seqlet_id"], o, bool(x), r["seqlet_id"] == root_id) for r, o, x in zip(rows, offsets.tolist(), strands.tolist(), strict=True)]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in ALIGNED.split(", ")])


def sample_clusters(obs: DataFrame, max_n: int, seed: int = 123) -> DataFrame:
    """Of each cluster with more than ``max_n`` seqlets, those at the places that Python's generator, seeded anew for
    each cluster, draws from the list of its seqlets in order of their ids.

    The places follow from the cluster's size alone, so only sizes reach the generator.
    """

    def draw(batches):
        for pdf in batches:
            rows = [(c, i + 1) for c, n in zip(pdf["leiden"], pdf["n"], strict=True) for i in random.Random(seed).sample(range(n), max_n)]
            yield pd.DataFrame(rows, columns=["leiden", "_r"])

    sizes = obs.groupBy("leiden").agg(F.count("*").alias("n"))
    drawn = sizes.where(F.col("n") > max_n).mapInPandas(draw, "leiden string, _r int")
    numbered = obs.withColumn("_r", F.row_number().over(Window.partitionBy("leiden").orderBy("seqlet_id")))
    small = obs.join(sizes.where(F.col("n") <= max_n).select(F.col("leiden").alias("_c")), F.col("leiden").eqNullSafe(F.col("_c")), "left_semi")
    return small.unionByName(numbered.join(drawn, ["leiden", "_r"], "left_semi").drop("_r"))


def aligned_instances(rows: DataFrame) -> DataFrame:
    """The instance of each seqlet under its pattern's window, from (start, end, offset, is_revcomp,
    longest, oh, contrib); columns of the arrays aside, all stay.

    Where the window leaves the example, the seqlet stays where it is, with zeros to its right.
    """
    span = A.aligned_span(F.col("start"), F.col("end"), F.col("offset"), F.col("longest"), F.col("is_revcomp"))
    out = rows.withColumn("_span", span)
    cut = lambda c: A.windowed(F.col(c), F.col("start"), F.col("end"), F.col("_span.start"), F.col("longest"))
    turned = lambda m: F.when(F.col("is_revcomp"), A.reverse_complement(m)).otherwise(m)
    out = out.withColumns({"seq_instance": turned(A.transpose(cut("oh"))), "hypothetical": turned(A.transpose(cut("contrib")))})
    return out.withColumn("contrib", A.product(F.col("seq_instance"), F.col("hypothetical"))).drop("_span", "oh")


def align_instances(obs: DataFrame, examples: DataFrame, max_n: int | None = None) -> DataFrame:
    """M9: aligned instances of the clusters with two seqlets or more, all of them unless ``max_n`` is given.

    The root is found all against all, see ``find_roots``; every seqlet then meets its root and the root's null, a row each.
    No task holds a cluster.  A window is as long as the longest seqlet of its cluster; the instances are cut by array
    functions, example by example.
    """
    rows = sample_clusters(obs, max_n) if max_n else obs
    big = rows.where(F.col("leiden").isNotNull()).groupBy("leiden").agg(F.count("*").alias("_size"), F.max(F.col("end") - F.col("start")).alias("longest")).where("_size >= 2")
    mine = rows.select("leiden", "seqlet_id", "example_idx", "start", "end", "seqlet_matrix").join(big, "leiden")
    mine = materialise(mine, "pattern-seqlets")  # read again and again
    roots = materialise(find_roots(mine, BLOCK), "pattern-roots")
    # Dealt evenly before what costs far more than moving the rows: adaptive execution would gather small inputs in few tasks.
    n = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = mine.select("leiden", "seqlet_id", "seqlet_matrix").repartition(n, "seqlet_id").join(F.broadcast(roots), "leiden")  # a root a cluster
    aligned = materialise(met.mapInArrow(_align_to_root, ALIGNED), "pattern-aligned")
    placed = mine.drop("_size", "seqlet_matrix").join(aligned, ["leiden", "seqlet_id"]).repartition(n, "example_idx")
    placed = placed.join(examples.select("example_idx", "oh", "contrib").repartition(n, "example_idx"), "example_idx")
    return aligned_instances(placed).select(*INSTANCES)


def element_mean(instances: DataFrame, column: str) -> DataFrame:
    """(leiden, column): mean matrix of each cluster, by position and base."""
    cells = instances.select("leiden", F.posexplode(column).alias("pos", "_row")).select("leiden", "pos", F.posexplode("_row").alias("base", "v"))
    means = cells.groupBy("leiden", "pos", "base").agg(F.avg("v").alias("v"))
    rows = means.groupBy("leiden", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("base", "v"))), lambda s: s["v"]).alias("row"))
    return rows.groupBy("leiden").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row"))), lambda s: s["row"]).alias(column))


def create_patterns(obs: DataFrame, examples: DataFrame, max_n: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances).  A pattern has its PPM, mean contributions, information content, size and domain."""
    instances = materialise(align_instances(obs, examples, max_n), "pattern-instances")  # read five times
    size = instances.groupBy("leiden").agg(F.count("*").alias("n_seqlets"))
    patterns = size
    for c in ("seq_instance", "contrib", "hypothetical"):
        patterns = patterns.join(element_mean(instances, c), "leiden")
    patterns = patterns.withColumn("ppm", A.normalise_ppm(F.col("seq_instance"))).drop("seq_instance")
    patterns = patterns.withColumn("ic", A.information_content(F.col("ppm")))
    named = next((c for c in ("cluster_dbd", "seqlet_dbd") if c in obs.columns), None)
    if named:
        patterns = patterns.join(mode_smallest(obs, ["leiden"], named, "dbd"), "leiden", "left")
    else:
        patterns = patterns.withColumn("dbd", F.lit(None).cast("string"))
    return patterns.withColumn("mean_ic", A.total(F.col("ic")) / F.size("ic")), instances


def sort_patterns(patterns: DataFrame, by: str = "ic") -> DataFrame:
    """O4."""
    orders = {"ic": [F.desc("mean_ic"), "leiden"], "n_seqlets": [F.desc("n_seqlets"), "leiden"], "cluster_id": ["leiden"]}
    if by not in orders:
        raise ValueError(f"patterns can't be sorted by {by!r}")
    return patterns.orderBy(*orders[by])


def representatives(patterns: DataFrame, key: str = "dbd", score: str = "mean_ic", name: str = "leiden") -> DataFrame:
    """The pattern of each domain with the highest mean information content, the first of equals."""
    known = patterns.where(F.col(key).isNotNull())
    return known.groupBy(key).agg(F.min_by(name, F.struct(-F.col(score), F.col(name))).alias(name)).orderBy(key)
