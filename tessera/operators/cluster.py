"""Clustering of similarity rows: PCA, nearest neighbours, Leiden communities, t-SNE, and domains per cluster.

Communities are found over tables of edges, by the same steps at every size.  Neighbours are exact, block by block, up to a limit,
and come from an index of cells beyond; t-SNE runs on the driver up to a limit, and beyond it points are placed among landmarks.
No size is refused and every row has a result.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators.relational import mode_smallest, without_noise
from tessera.shared import drop, materialise, stored

#: Rows that are compared with all others, points that the driver's t-SNE takes.
EXACT_ROWS, TSNE_ROWS = 200_000, 3_000
#: Rows that the cells of the index are fitted on; every row is indexed.
INDEX_SAMPLE = 50_000
#: Queries that the number of cells to look in is set by, and the share of their neighbours that must be found.
ASKED, RECALL = 256, 0.95


def pca(rows: DataFrame, id_col: str, values: str, k: int = 50) -> DataFrame:
    """M4: (id, pca): centred, and each component signed so that its largest loading is positive."""
    vectors = rows.select(id_col, array_to_vector(values).alias("v"))
    d, n = len(rows.select(values).first()[0]), rows.count()
    k = max(1, min(k, n - 1, d))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(vectors).transform(vectors)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(centred)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(k)])
    flip = F.array(*(F.lit(float(s or 1)) for s in signs))
    return model.transform(centred).select(id_col, F.zip_with(vector_to_array("p"), flip, lambda x, s: x * s).alias("pca"))


NEAREST = "id long, neighbor array<long>, distance array<double>"
#: Queries and candidates of one product of matrices, and pairs whose distances are computed at a time.
ROWS, COLUMNS, PAIRS = 256, 4096, 1 << 18
#: Blocks that even a small table is dealt to on either side, of this many rows at least, so that all cores have some pairs.
BLOCKS, LEAST_ROWS = 8, 1024


def _first_copies(y: np.ndarray, m: int) -> np.ndarray:
    """Places of the first m of equal rows: as ties go to the smaller id, no later ones are among the nearest."""
    _, kind = np.unique(np.ascontiguousarray(y).view(np.dtype((np.void, y.shape[1] * y.itemsize))).ravel(), return_inverse=True)
    order = np.argsort(kind, kind="stable")
    kind = kind[order]
    return np.sort(order[np.arange(len(y)) - np.searchsorted(kind, kind) < m])


def _few(low: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns where ``low`` is not above its row's limit, looked for eight columns at a time."""
    mask = low <= limit[:, None]
    eights = np.flatnonzero(mask.view(np.uint64))
    at = (eights[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(at[mask.ravel()[at]], low.shape[1])


def _least(row: np.ndarray, value: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th smallest value of each of n rows; infinite where a row has fewer."""
    order = np.lexsort((value, row))
    row = row[order]
    kth = np.arange(len(row)) - np.searchsorted(row, row) == k - 1
    out = np.full(n, np.inf, value.dtype)
    out[row[kth]] = value[order][kth]
    return out


def _nearest(own: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest candidates (``ids``, ``y``) of each query (``own``, ``x``), the smaller id first where they are as near: how
    many each query has, then the neighbours and the distances of all.

    Products of matrices in single precision find who may be among them: half of the squared distance, less what is the same for
    all candidates, between bounds for the errors of rounding.  Distances and their order are then computed on the vectors.
    """
    counts, neighbors, distances = np.zeros(len(x), np.int64), [np.empty(0, np.int64)], [np.empty(0)]
    if not len(x) or not len(y):
        return counts, neighbors[0], distances[0]
    m = k + int(np.unique(ids, return_counts=True)[1].max())  # a query itself is no neighbour
    by_id = np.argsort(ids, kind="stable")
    by_id = by_id[_first_copies(y[by_id], m)]
    ids, y = ids[by_id], y[by_id]
    usual = y[np.isfinite(y).all(1)]
    middle = usual.mean(0) if len(usual) else 0.0
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.concatenate([(x**2).sum(1), (y**2).sum(1)])
        squares = np.concatenate([((x - middle) ** 2).sum(1), ((y - middle) ** 2).sum(1)])
        most = squares[np.isfinite(squares)].max(initial=0.0)
        single = 1e-20 < most < 1e30 and norms[np.isfinite(norms)].max(initial=0.0) < 1e14 * most
        if single:  # errors of sums of d + 1 products of rounded numbers; |x| |y| is at most half of both squares
            kind, unit = np.float32, (x.shape[1] + 8) * float(np.finfo(np.float32).eps) / 2
        else:
            kind, unit, middle, squares = np.float64, 1e-9, 0.0, norms
        ex, ey = unit * squares[: len(x)], 1.5 * unit * squares[len(x) :] + (1e-37 if single else 1e-300)
        none = -len(y) % 8  # columns come in eights
        left = np.concatenate([middle - x, np.ones((len(x), 1))], 1).astype(kind)
        right = np.concatenate([y - middle, (squares[len(x) :] / 2 - ey)[:, None]], 1)
        right = np.ascontiguousarray(np.concatenate([right, np.full((none, right.shape[1]), np.nan)]).astype(kind).T)
        more, slack = np.concatenate([2 * ey, np.full(none, np.nan)]).astype(kind), (2 * ex).astype(kind)
        above = lambda limit, lo: np.nextafter(np.where(np.isnan(limit), np.inf, limit) + slack[lo : lo + ROWS], np.inf, dtype=kind)
        for lo in range(0, len(x), ROWS):
            part, mine = left[lo : lo + ROWS], own[lo : lo + ROWS]
            limit, row, col, low = np.full(len(part), np.inf, kind), np.empty(0, int), np.empty(0, int), np.empty(0, kind)
            for i, to in enumerate(range(0, right.shape[1], COLUMNS)):
                found = part @ right[:, to : to + COLUMNS]
                if not i and found.shape[1] >= m:
                    limit = above(np.partition(found + more[:COLUMNS], m - 1, axis=1)[:, m - 1], lo)
                r, c = _few(found, limit)
                keep = np.isfinite(found[r, c]) & (ids[np.minimum(c + to, len(ids) - 1)] != mine[r])
                r, c = r[keep], c[keep]
                row, col, low = np.concatenate([row, r]), np.concatenate([col, c + to]), np.concatenate([low, found[r, c]])
                if i & (i + 1) == 0 or to + COLUMNS >= right.shape[1]:  # after 1, 2, 4, ... products and the last
                    limit = np.minimum(limit, above(_least(row, low + more[col], len(part), k), lo))
                    keep = low <= limit[row]
                    row, col, low = row[keep], col[keep], low[keep]
            exact = np.empty(len(row))
            for p in range(0, len(row), PAIRS):
                exact[p : p + PAIRS] = np.sqrt(((x[lo + row[p : p + PAIRS]] - y[col[p : p + PAIRS]]) ** 2).sum(1))
            order = np.lexsort((ids[col], exact, row))
            row, col, exact = row[order], col[order], exact[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            counts[lo : lo + ROWS] = np.bincount(row[keep], minlength=len(part))
            neighbors.append(ids[col[keep]])
            distances.append(exact[keep])
    return counts, np.concatenate(neighbors), np.concatenate(distances)


def _as_rows(own: np.ndarray, counts: np.ndarray, neighbor: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (neighbor.astype(np.int64), distance)]
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), *lists], ["id", "neighbor", "distance"])


def _vectors(column: pa.Array) -> np.ndarray:
    """A matrix of the rows of a column of lists."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(sizes) and not (sizes == sizes[0]).all():
        raise ValueError("vectors must have one length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)


def _pairs_of_blocks(batches, k: int):
    """What rows ask for and what they are compared with, told apart by ``is_query``: one pair of blocks a task, or none."""
    parts = [b for b in batches if b.num_rows]
    if parts:
        t = pa.Table.from_batches(parts).combine_chunks()
        asked = t["is_query"].to_numpy()
        own, v = t["id"].to_numpy(), np.concatenate([_vectors(c) for c in t["v"].chunks])
        yield _as_rows(own[asked], *_nearest(own[asked], v[asked], own[~asked], v[~asked], k))


def _nearest_of_group(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    q, c = pdf[pdf.is_query], pdf[~pdf.is_query]
    if q.empty or c.empty:
        return pd.DataFrame({"id": [], "neighbor": [], "distance": []}, dtype=object)
    near = _nearest(q.id.to_numpy(), np.stack(q.v), c.id.to_numpy(), np.stack(c.v), k)
    return _as_rows(q.id.to_numpy(), *near).to_pandas()


def _best(found: DataFrame, id_col: str, k: int) -> DataFrame:
    all_of = found.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("distance", "neighbor")))).alias("_n"))
    once = F.filter("_n", lambda x, i: (i == 0) | (x != F.get("_n", i - 1)))
    best = all_of.select(F.col("id").alias(id_col), F.posexplode(F.slice(once, 1, k)).alias("rank", "_x"))
    return best.select(id_col, F.col("_x.neighbor").alias("neighbor"), F.col("_x.distance").alias("distance"), (F.col("rank") + 1).alias("rank"))


def knn(rows: DataFrame, id_col: str, values: str, k: int = 15, block: int = 65_536) -> DataFrame:
    """M5: exact nearest neighbours (id, neighbor, distance, rank) by Euclidean distance, ties by the smaller id.

    Rows are dealt to blocks; each task holds one block of queries against one block of candidates and keeps k per query, and
    the k nearest of all blocks are merged, so memory is bounded and only k rows per query and block are shuffled.
    """
    count = rows.count()
    n = max(1, -(-count // block), min(BLOCKS, count // LEAST_ROWS))
    dealt = rows.select(F.col(id_col).cast("long").alias("id"), F.col(values).cast("array<double>").alias("v")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    everyone = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = dealt.select("id", "v", F.col("b").alias("qb"), everyone.alias("cb"), F.lit(True).alias("is_query"))
    candidates = dealt.select("id", "v", everyone.alias("qb"), F.col("b").alias("cb"), F.lit(False).alias("is_query"))
    pairs = queries.unionByName(candidates).repartitionById(n * n, F.col("qb") * n + F.col("cb"))
    return _best(pairs.select("id", "v", "is_query").mapInArrow(lambda batches: _pairs_of_blocks(batches, k), NEAREST), id_col, k)


def knn_index(rows: DataFrame, id_col: str, values: str, k: int = 15, cells: int | None = None, probes: int | None = None, queries: DataFrame | None = None, block: int = 16_384) -> DataFrame:
    """M5 beyond ``EXACT_ROWS``: the nearest among the rows of the ``probes`` cells that lie nearest to a query.  Unless it is
    given, their number is the least by which ``ASKED`` rows, compared with all others, find ``RECALL`` of their neighbours.

    Cells are k-means centres (the square root of the number of rows, at most 4096) of a sample of ``INDEX_SAMPLE`` rows by a
    hash of their ids; every row is in its nearest cell.  A cell over ``block`` rows is split, and its queries meet each part.
    ``queries`` (id_col, values) default to all rows.
    """
    from pyspark.ml.clustering import KMeans

    spark = rows.sparkSession
    data = rows.select(F.col(id_col).cast("long").alias("id"), F.col(values).cast("array<double>").alias("v"))
    n = data.count()
    cells = cells or max(1, min(4096, int(n**0.5)))
    least = INDEX_SAMPLE / max(n, 1)
    sample = data if least >= 1 else data.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < int(least * 1_000_000))
    centres = np.stack(KMeans(k=cells, seed=7, maxIter=10, featuresCol="f").fit(sample.select(array_to_vector("v").alias("f"))).clusterCenters())
    shared = spark.sparkContext.broadcast(centres)  # 4096 rows at most

    def place(probes: int):
        def run(batches):
            c = shared.value
            norms = (c**2).sum(1)
            for pdf in batches:
                if len(pdf):
                    d = norms[None] - 2 * np.stack(pdf.v) @ c.T
                    near = np.argsort(d, axis=1, kind="stable")[:, :probes]
                    yield pd.DataFrame({"id": pdf.id, "v": pdf.v, "cells": [r.tolist() for r in near]})

        return run

    placed = "id long, v array<double>, cells array<int>"
    candidates = materialise(data.mapInPandas(place(1), placed).select("id", "v", F.get("cells", F.lit(0)).alias("cell")), "knn-cells")
    probes = probes or _probes(data, candidates, centres, k)
    parts = candidates.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))  # a row per cell
    asked = data if queries is None else queries.select(F.col(id_col).cast("long").alias("id"), F.col(values).cast("array<double>").alias("v"))
    to = asked.mapInPandas(place(probes), placed).select("id", "v", F.explode("cells").alias("cell")).join(F.broadcast(parts), "cell")
    to = to.select("id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_query"))
    held = candidates.join(F.broadcast(parts), "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("is_query"))
    # Queries of a hot cell are dealt too: each task has some of them and one part of the cell.
    spread = to.withColumn("deal", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(8)).cast("int")).unionByName(held.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(7)))))
    found = spread.groupBy("cell", "part", "deal").applyInPandas(lambda pdf: _nearest_of_group(pdf, k), NEAREST)
    return _best(found, id_col, k)


def _probes(data: DataFrame, candidates: DataFrame, centres: np.ndarray, k: int) -> int:
    """Cells to look in: measured on rows with the smallest hashes of their ids, whose neighbours are found among all."""
    local = data.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(ASKED).toPandas()
    shared = data.sparkSession.sparkContext.broadcast(local)

    def run(batches):
        asked = shared.value.assign(is_query=True)
        for pdf in batches:
            if len(pdf):
                yield _nearest_of_group(pd.concat([asked, pdf[["id", "v"]].assign(is_query=False)]), k)

    true = _best(data.mapInPandas(run, NEAREST), "id", k).join(candidates.select(F.col("id").alias("neighbor"), "cell"), "neighbor").select("id", "cell").toPandas()  # ASKED * k rows
    x = np.stack(local["v"])
    order = np.argsort((centres**2).sum(1)[None] - 2 * x @ centres.T, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(centres))[None].repeat(len(x), 0), 1)
    row = {i: r for r, i in enumerate(local["id"])}
    ranks = np.sort([rank[row[i], c] for i, c in zip(true["id"], true["cell"], strict=True)])
    return int(ranks[min(int(RECALL * len(ranks)), len(ranks) - 1)]) + 1 if len(ranks) else 1


def neighbours(rows: DataFrame, id_col: str, values: str, k: int = 15) -> DataFrame:
    """M5: exact up to ``EXACT_ROWS`` rows, by the index beyond."""
    return (knn if rows.count() <= EXACT_ROWS else knn_index)(rows, id_col, values, k)


def tsne(x: np.ndarray, perplexity: float = 30.0, seed: int = 42, iterations: int = 500) -> np.ndarray:
    """M6: exact t-SNE (van der Maaten & Hinton 2008) from the first two principal components."""
    n = len(x)
    if n < 4:
        return np.zeros((n, 2))
    perplexity = min(perplexity, (n - 1) / 3)
    d = np.stack([((x - r) ** 2).sum(1) for r in x])
    p = np.zeros((n, n))
    for i in range(n):
        low, high, beta, row = 0.0, np.inf, 1.0, np.delete(d[i], i)
        for _ in range(50):
            e = np.exp(-(row - row.min()) * beta)
            q = e / e.sum()
            h = -(q * np.log(np.maximum(q, 1e-300))).sum()
            if abs(h - np.log(perplexity)) < 1e-5:
                break
            if h > np.log(perplexity):
                low, beta = beta, beta * 2 if np.isinf(high) else (beta + high) / 2
            else:
                high, beta = beta, (beta + low) / 2
        p[i, np.arange(n) != i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
    y = (u * s)[:, :2] if x.shape[1] > 1 else np.column_stack([x[:, 0], np.zeros(n)])
    y = y / (y[:, 0].std() or 1) * 1e-4 + np.random.default_rng(seed).normal(0, 1e-6, (n, 2))
    velocity, rate = np.zeros_like(y), max(n / 12 / 4, 50)
    for t in range(iterations):
        square = (y**2).sum(1)
        num = 1 / (1 + np.maximum(square[:, None] + square[None] - 2 * y @ y.T, 0))
        np.fill_diagonal(num, 0)
        pull = (p * (12 if t < 150 else 1) - np.maximum(num / num.sum(), 1e-12)) * num
        grad = 4 * (pull.sum(1)[:, None] * y - pull @ y)
        velocity = (0.5 if t < 150 else 0.8) * velocity - rate * grad
        y = y + velocity
    return y - y.mean(0)


def embed(rows: DataFrame, id_col: str, values: str, seed: int = 42) -> DataFrame:
    """M6: (id, x, y) of every row.  Up to ``TSNE_ROWS`` rows by t-SNE; beyond, that many rows, those with the smallest hashes
    of their ids, are landmarks that t-SNE places, and each row lies at the mean of its three nearest landmarks, weighted by
    the inverse of their distance (a landmark, at its own place)."""
    spark, key = rows.sparkSession, dict(rows.dtypes)[id_col]
    data = rows.select(F.col(id_col), F.col(values).cast("array<double>").alias("v"))
    local = data.orderBy(F.xxhash64(id_col), id_col).limit(TSNE_ROWS).toPandas().sort_values(id_col)
    if not len(local):
        return spark.createDataFrame([], f"{id_col} {key}, x double, y double")
    marks, places = np.stack(local["v"]), None
    places = tsne(marks, seed=seed)
    shared = spark.sparkContext.broadcast((marks, places))  # TSNE_ROWS rows

    def run(batches):
        marks, places = shared.value
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                x = np.stack(part["v"])
                near = np.argsort((marks**2).sum(1)[None] - 2 * x @ marks.T, axis=1, kind="stable")[:, :3]
                weight = 1 / (np.sqrt(((x[:, None] - marks[near]) ** 2).sum(2)) + 1e-12)
                at = (places[near] * weight[:, :, None]).sum(1) / weight.sum(1)[:, None]
                yield pd.DataFrame({id_col: part[id_col], "x": at[:, 0], "y": at[:, 1]})

    if len(local) < TSNE_ROWS:
        points = [(i.item() if hasattr(i, "item") else i, float(a), float(b)) for i, (a, b) in zip(local[id_col], places, strict=True)]
        return spark.createDataFrame(points, f"{id_col} {key}, x double, y double")
    return data.mapInPandas(run, f"{id_col} {key}, x double, y double")


#: Turns of moves per level, and the share of nodes that two turns together must still move for another.
TURNS, STILL = 16, 0.02
#: Edges that one task of a turn sends.
EDGES = 65_536


def _goes(node: str, seed: int) -> str:
    """Half of the nodes in one turn and the other half in the next; then another half."""
    return f"pmod(xxhash64({node}, {seed}, shiftright(turn, 1)), 2) = turn % 2"


def _lists(edges: DataFrame, state: DataFrame, refine: bool) -> tuple[DataFrame, int]:
    """Whom each node meets (b, met: an array of a, w and a's degree), and in how many parts by b: kept for the turns of a level,
    in which only labels change.  To refine, nodes meet inside communities only."""
    met = edges.where("a <> b").join(state.selectExpr("node AS a", "degree", "inside AS _in"), "a")
    if refine:
        met = met.join(state.selectExpr("node AS b", "inside AS _own"), "b").where("_in = _own")
    parts = max(1, -(-edges.count() // EDGES))
    return met.repartition(parts, "b").groupBy("b").agg(F.expr("collect_list(struct(a, w, degree)) AS met")).persist(), parts


def _turn(lists: DataFrame, parts: int, state: DataFrame, total: float, resolution: float, seed: int, refine: bool) -> DataFrame:
    """One turn of moves over ``lists``: (node, degree, label, inside, turn, moved).

    Half of the nodes go to the neighbouring label of the highest gain, the smallest of equals, if it is higher than where they
    are.  To refine, only nodes that are alone under their label move, and only to labels inside their community (``inside``)
    that a neighbour has who stays in this turn: what they join is connected to them and keeps being so.

    Each node tells its label, with the label's mass, to itself and to those neighbours that may go, so edges are shuffled once.
    The number of the turn is a column, so that all turns of a level have one plan, whose code is compiled once.
    """
    itself = "array(struct(s.node AS a, 0D AS w, s.degree))"
    told = f"concat({itself}, coalesce(met, array()))"
    if refine:
        told = f"CASE WHEN {_goes('s.node', seed)} THEN {itself} ELSE {told} END"
    moved = f"{_goes('a', seed)} AND best.gain > stay + 1e-12D" + " AND n = 1" * refine
    kept = ", ".join(f"max({c}) AS {c}" for c in ("degree", "turn", "n", "inside"))
    return state.sparkSession.sql(
        f"""
        WITH masses AS (SELECT label, sum(degree) AS mass, count(*) AS n FROM {{state}} GROUP BY label),
        told AS (
            SELECT /*+ SHUFFLE_HASH(l) */ s.node, s.label AS to, m.mass, m.n, s.inside, s.turn, explode({told}) AS x
            FROM {{state}} s JOIN masses m ON s.label = m.label LEFT JOIN {{lists}} l ON s.node = l.b),
        sent AS (SELECT x.a, x.w, x.degree, to, mass, turn, x.a = node AS own, n, inside FROM told),
        dealt AS (
            SELECT /*+ REPARTITION({parts}, a) */ a, w, degree, to, mass, turn, own, if(own, n, NULL) AS n, if(own, inside, NULL) AS inside
            FROM sent WHERE own OR {_goes("a", seed)}),
        at AS (SELECT a, to, sum(w) AS w, max(mass) AS mass, max(own) AS own, {kept} FROM dealt GROUP BY a, to),
        gains AS (SELECT *, w - {float(resolution)!r}D * degree * (mass - if(own, degree, 0D)) / {float(total)!r}D AS gain FROM at),
        best AS (
            SELECT a, max(struct(gain, -to AS less)) AS best, max(if(own, gain, NULL)) AS stay, max(if(own, to, NULL)) AS label, {kept}
            FROM gains GROUP BY a),
        moves AS (SELECT *, coalesce({moved}, false) AS moved FROM best)
        SELECT a AS node, degree, if(moved, -best.less, label) AS label, inside, turn + 1 AS turn, moved FROM moves""",
        state=state,
        lists=lists,
    )


def _settle(edges: DataFrame, state: DataFrame, n: int, total: float, resolution: float, seed: int, refine: bool) -> tuple[DataFrame, str, int]:
    """Turns until the halves that two turns ask hardly move; the last state, its path, and how many moved in all."""
    spark, path, before, moves = edges.sparkSession, None, 0, 0
    lists, parts = _lists(edges, state, refine)
    state = state.selectExpr("node", "degree", "label", "inside", "0 AS turn")
    for turn in range(TURNS):
        seen = Observation()
        step, to = stored(_turn(lists, parts, state, total, resolution, seed + refine, refine).observe(seen, F.count_if("moved").alias("moved")), "communities")
        if path:
            drop(spark, path)
        state, path = step, to
        now = seen.get["moved"]
        moves += now
        if turn % 2 and before + now <= STILL * n:  # both halves were asked
            break
        before = now
    lists.unpersist()
    return state, path, moves


def _joined(labels: DataFrame, edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, label) with the parts of each label that no edge connects under labels of their own, the smallest node's."""
    spark = edges.sparkSession
    a, b = (labels.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
    near, near_at = stored(edges.where("a <> b").join(a, "a").join(b, "b").where("la = lb").select("a", "b"), "communities-inside")
    parts, path = stored(labels.select("node", F.col("node").alias("label")), "communities-parts")
    while True:
        low = near.join(parts.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("low"))
        step = parts.join(low.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("low", "label")).alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        made, to = stored(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "communities-parts")
        drop(spark, path)
        parts, path = made.select("node", "label"), to
        if made.where("label <> old").isEmpty():
            drop(spark, near_at)
            return parts, path


def _renamed(members: DataFrame, names: DataFrame) -> DataFrame:
    """``members`` (node, label) with the names (node, label) that their labels have got."""
    to = names.select(F.col("node").alias("_old"), F.col("label").alias("_new"))
    return members.join(to, F.col("label") == F.col("_old")).select("node", F.col("_new").alias("label"))


def communities(neighbors: DataFrame, id_col: str, resolution: float, seed: int = 0) -> DataFrame:
    """M7 over k-NN edges: (id, leiden), larger communities first.

    Leiden's steps over tables, the same at every size: nodes move to neighbouring communities in turns, each community is
    refined into parts that its edges connect, the parts become the nodes of a smaller graph that begins with the communities
    found, and so on.  Where no two parts join any more, whole communities are the nodes, each told apart first if no edges hold it
    together, until none joins another.  A turn is a few joins and one table; only counts reach the driver.
    """
    spark = neighbors.sparkSession
    pairs = neighbors.select(F.col(id_col).cast("long").alias("a"), F.col("neighbor").cast("long").alias("b"))
    once = pairs.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").cast("double").alias("w"))
    once = once.withColumn("w", F.lit(1.0))  # neighbours of each other count once
    edges, edges_at = stored(once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "communities-graph")
    degree = edges.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("degree"))
    state, state_at = stored(degree.select("node", "degree", F.col("node").alias("label"), F.col("node").alias("inside")), "communities")
    n, total = state.agg(F.count("*"), F.sum("degree")).first()
    if not n:
        return state.select(F.col("node").alias(id_col), F.lit(None).cast("string").alias("leiden"))
    members, members_at = None, None
    while True:
        found, found_at, _ = _settle(edges, state, n, total, resolution, seed, False)
        alone = found.select("node", "degree", F.col("node").alias("label"), F.col("label").alias("inside"))
        fine, fine_at, merged = _settle(edges, alone, n, total, resolution, seed, True)
        drop(spark, state_at)
        if not merged:  # whole communities may still join others
            drop(spark, fine_at)
            whole, fine_at = _joined(found.select("node", "label"), edges)
            if whole.select("label").distinct().count() == n:
                break
            fine = whole.join(found.select("node", "degree"), "node").withColumn("inside", F.col("label"))
        name = fine.select("node", "label")
        step = name if members is None else _renamed(members, name)
        step, step_at = stored(step, "communities-members")
        a, b = (name.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        smaller, smaller_at = stored(edges.join(a, "a").join(b, "b").groupBy(F.col("la").alias("a"), F.col("lb").alias("b")).agg(F.sum("w").alias("w")), "communities-graph")
        # A part begins in the community that it was found in, named by one of the community's parts.
        parts = fine.groupBy("label").agg(F.sum("degree").alias("degree"), F.first("inside").alias("inside"))
        first = parts.groupBy("inside").agg(F.min("label").alias("label"))
        begin = parts.select(F.col("label").alias("node"), "degree", "inside").join(first, "inside").select("node", "degree", "label", F.col("node").alias("inside"))
        state, state_at = stored(begin, "communities")
        drop(spark, edges_at, found_at, fine_at, *([members_at] if members_at else []))
        members, members_at, edges, edges_at, n = step, step_at, smaller, smaller_at, state.count()
    whole = materialise(whole if members is None else _renamed(members, whole), "communities-found")
    drop(spark, edges_at, found_at, fine_at, *([members_at] if members_at else []))
    rank = whole.groupBy("label").agg(F.count("*").alias("n")).select("label", (F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1).cast("string").alias("leiden"))  # a row per community
    return whole.join(rank, "label").select(F.col("node").alias(id_col), "leiden")


def modularity(neighbors: DataFrame, labels: DataFrame, id_col: str, resolution: float = 1.0) -> float:
    """Of the communities ``labels`` (id, leiden) of the graph of ``neighbors``: what lies inside less what chance would put there."""
    pairs = neighbors.where(F.col(id_col) != F.col("neighbor")).select(F.least(id_col, "neighbor").alias("a"), F.greatest(id_col, "neighbor").alias("b")).distinct()
    a, b = (labels.select(F.col(id_col).alias(x), F.col("leiden").alias(f"l{x}")) for x in "ab")
    met = pairs.join(a, "a").join(b, "b")
    m, inside = met.agg(F.count("*"), F.count_if(F.col("la") == F.col("lb"))).first()
    mass = met.select("la").union(met.select("lb")).groupBy("la").agg((F.count("*") / (2.0 * max(m, 1))).alias("share"))
    return inside / max(m, 1) - resolution * (mass.agg(F.sum(F.col("share") * F.col("share"))).first()[0] or 0.0)


def top_motif_dbd(similarity: DataFrame, id_col: str, values: str, dbd: list[str | None], keep: list[str] | None = None) -> DataFrame:
    """The domain of the motif that a seqlet is most similar to (the first of equals); and the columns ``keep``."""
    names = F.array(*map(F.lit, dbd)).cast("array<string>")
    at = A.first_argmax(F.col(values))
    return similarity.select(id_col, *(keep or []), at.alias("motif_idx"), F.get(names, at).alias("seqlet_dbd"))


def cluster_dbd(obs: DataFrame) -> DataFrame:
    """Adds cluster_dbd, the most frequent domain of each cluster."""
    return obs.join(mode_smallest(obs, ["leiden"], "seqlet_dbd", "cluster_dbd"), "leiden", "left")


def cluster_seqlets(obs: DataFrame, similarity: DataFrame | None, dbd: list[str | None] | None = None, resolution: float = 3.0, k: int = 15, seed: int = 0) -> DataFrame:
    """M8: obs with leiden, x, y, mean_contrib, seqlet_dbd and cluster_dbd."""
    if similarity is None:
        raise ValueError("clustering needs a similarity matrix")
    reduced = materialise(pca(similarity, "seqlet_id", "sim"), "cluster-pca")
    labels = communities(neighbours(reduced, "seqlet_id", "pca", k), "seqlet_id", resolution, seed)
    points = embed(reduced, "seqlet_id", "pca")
    out = obs.join(labels, "seqlet_id", "left").join(points, "seqlet_id", "left")
    if "seqlet_matrix" in obs.columns:
        out = out.withColumn("mean_contrib", A.mean_abs(F.col("seqlet_matrix")))
    else:
        warnings.warn("no seqlet_matrix: mean_contrib is null", stacklevel=2)
        out = out.withColumn("mean_contrib", F.lit(None).cast("double"))
    if dbd is None:
        warnings.warn("no domains of motifs: seqlet_dbd and cluster_dbd are null", stacklevel=2)
        return out.withColumns({c: F.lit(None).cast("string") for c in ("seqlet_dbd", "cluster_dbd")})
    return cluster_dbd(out.join(top_motif_dbd(similarity, "seqlet_id", "sim", dbd).drop("motif_idx"), "seqlet_id", "left"))


def second_round(obs: DataFrame, similarity: DataFrame, dbd: list[str | None] | None = None, resolution: float = 10.0, only: str | None = None, **kw) -> DataFrame:
    """Clusters the seqlets that have a domain (or this one) anew; the columns of the first round are replaced."""
    first = ("leiden", "x", "y", "mean_contrib", "seqlet_dbd", "cluster_dbd")
    kept = without_noise(obs, "cluster_dbd", only).drop(*first)
    return cluster_seqlets(kept, similarity.join(kept.select("seqlet_id"), "seqlet_id", "left_semi"), dbd, resolution, **kw)


def cluster_regions(region_topic_wide: DataFrame, resolution: float = 0.5, k: int = 15, seed: int = 0) -> DataFrame:
    """(region_id, leiden) of regions by their topics, one column Topic_n each."""
    names = [c for c in region_topic_wide.columns if c.startswith("Topic_")]
    numbered = materialise(region_topic_wide.select("region_id", F.array(*names).alias("v")).withColumn("_id", F.monotonically_increasing_id()), "region-topics")
    found = communities(neighbours(numbered, "_id", "v", k), "_id", resolution, seed)
    return numbered.select("_id", "region_id").join(found, "_id").drop("_id")


#: Rows and columns of a heatmap whose order is asked for.
LINKED = 2_000


def linkage_order(rows: np.ndarray) -> list[int]:
    """Order of rows by average linkage.  The closest pair is kept per group, so a merge costs one row of distances."""
    n = len(rows)
    if n > LINKED:
        raise ValueError(f"a heatmap of {n} rows can't be read; order {LINKED} at most")
    if n < 2:
        return list(range(n))
    d = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    groups, size = {i: [i] for i in range(n)}, np.ones(n)
    while len(groups) > 1:
        a, b = sorted(divmod(int(d.argmin()), n))
        merged = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        merged[[a, b]] = np.inf
        d[a], d[:, a], d[b], d[:, b] = merged, merged, np.inf, np.inf
        size[a] += size[b]
        groups[a] += groups.pop(b)
    return next(iter(groups.values()))
