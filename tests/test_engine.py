"""Invariants of the engine's operators, on seeded synthetic data."""

import glob
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import align, bounds, cluster, dataset, patterns, relational, seqlets, topics
from tessera.plans import plotdata
from tessera.plans import parity as _parity  # noqa: F401
from tessera.plans import queries as Q
from tessera.sources import readers

SF = "/root/testdata/sf0.001"


def rows(n=40, length=60, seed=3):
    """Examples with a planted motif, forward in most and reversed in some; one is all zero."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        oh = np.eye(4)[rng.integers(0, 4, length)].T
        contrib = rng.normal(0, 0.05, (4, length))
        word = np.eye(4)[[0, 2, 2, 0, 0, 1, 3, 0]].T
        if i < n - 8:
            oh[:, 20:28] = word if i % 3 else word[::-1, ::-1]
            contrib[:, 20:28] += oh[:, 20:28] * (-1.0 if i % 10 == 9 else 1.0) * (1 + rng.random())
        if i == n - 1:
            contrib[:] = 0
        out.append((i, contrib.tolist(), oh.tolist()))
    return out


@pytest.fixture(scope="module")
def examples(spark):
    return spark.createDataFrame(rows(), readers.EXAMPLES).persist()


@pytest.fixture(scope="module")
def found(examples):
    return seqlets.extract_seqlets(examples, 0.05).persist()


def test_array_functions_against_numpy(spark):
    rng = np.random.default_rng(1)
    m, o = rng.normal(size=(4, 9)), np.eye(4)[rng.integers(0, 4, 9)].T
    df = spark.createDataFrame([(m.tolist(), o.tolist())], "m array<array<double>>, o array<array<double>>")
    c, h = F.col("m"), F.col("o")
    got = df.select(
        A.project(c, h).alias("p"), A.transpose(c).alias("t"), A.normalise(c).alias("n"), A.sign_correct(c, h).alias("s"),
        A.mean_abs(c).alias("a"), A.reverse_complement(A.transpose(c)).alias("r"), A.normalise_ppm(A.transpose(h)).alias("q"),
        A.information_content(A.transpose(h)).alias("i"), A.consensus(A.transpose(h)).alias("w"), A.slice_columns(c, F.lit(2), F.lit(5)).alias("k"),
        A.windowed(c, F.lit(6), F.lit(9), F.lit(6), F.lit(6)).alias("z"),
    ).first()
    assert np.allclose(got["p"], (m * o).sum(0))
    assert np.allclose(got["t"], m.T)
    assert np.allclose(got["n"], m / np.abs(m).max())
    assert np.allclose(got["s"], np.sign((m * o).mean()) * m)
    assert np.isclose(got["a"], np.abs(m).mean())
    assert np.allclose(got["r"], m.T[::-1, ::-1])
    assert np.allclose(got["q"], o.T)
    assert np.allclose(got["i"], 1.9968, atol=0.01)
    assert got["w"] == "".join("ACGT"[i] for i in o.argmax(0))
    assert np.allclose(got["k"], m[:, 2:5])
    assert np.allclose(got["z"], np.pad(m[:, 6:], ((0, 0), (0, 3))))


@pytest.mark.parametrize("mask,span", [("001100", (1, 4)), ("1100", (1, 2)), ("0011", (1, 2)), ("1111", (0, 0)), ("0000", (0, 0))])
def test_ic_trim_keeps_the_change_points(spark, mask, span):
    df = spark.createDataFrame([([float(c) for c in mask],)], "ic array<double>")
    assert tuple(df.select(A.ic_trim(F.col("ic"), 0.5).alias("t")).first()["t"]) == span


def test_sign_zero_gives_zero_matrix(spark):
    df = spark.createDataFrame([([[1.0, -1.0]] * 4, [[1.0, 1.0]] * 4)], "m array<array<double>>, o array<array<double>>")
    assert not np.any(df.select(A.sign_correct(F.col("m"), F.col("o")).alias("s")).first()["s"])


def test_span_p_values_equal_the_callers(spark):
    rng = np.random.default_rng(4)
    data = [(i, (rng.normal(size=n) * (i != 3)).tolist()) for i, n in enumerate([40, 26, 25, 30, 7, 4, 3, 0])]
    df = spark.createDataFrame(data, "example_idx long, x array<double>")
    bg = seqlets.Background.of(df)
    want = {}
    for i, x in data:
        p = seqlets.p_matrix(np.array(x), bg, 0.05)
        want |= {(i, j, k): p[j, k] for j in range(4, min(25, len(x)) + 1) for k in range(len(x) - j + 1)}
    made = seqlets.span_p_values(df, 0.05)
    assert {(r["example_idx"], r["len"], r["start"]): r["p"] for r in made.collect()} == want
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_seqlets(found):
    local = found.toPandas()
    assert len(local) > 20
    assert (local["start"] < local["end"]).all() and (local["start"] >= 0).all() and (local["end"] <= 59).all()
    assert sorted(local["seqlet_id"]) == list(range(len(local)))
    assert local.sort_values("seqlet_id")["p_value"].is_monotonic_increasing
    for m, a, b in zip(local["seqlet_matrix"], local["start"], local["end"], strict=True):
        m = np.stack([np.asarray(r) for r in m])
        assert m.shape == (4, b - a) and np.abs(m).max() <= 1 + 1e-12
    assert ((local["start"] <= 22) & (local["end"] >= 26)).sum() >= 15  # about half of the planted ones at this threshold


def brute_calls(xs, threshold, shortest=4, longest=25, flank=0):
    """The caller cell by cell, from the specification."""
    sums = [np.concatenate([[0], np.cumsum(x)]) for x in xs]
    out, table = [], {}
    for j in range(shortest, longest + 1):
        every = [c[k + j] - c[k] for c in sums for k in range(len(c) - j)]
        for side in (True, False):
            part = [s for s in every if (s > 0) == side]
            top = max(part + [0]) if side else min(part + [0])
            hist = np.zeros(1000)
            for s in part:
                hist[int(np.floor(999 * s / top)) if top else 0] += 1
            table[j, side] = top, 1 - np.cumsum(hist) / max(len(part), 1)
    for i, c in enumerate(sums):
        n = len(c) - 1
        p = np.ones((longest + 1, n))
        for k in range(n):
            for j in range(shortest, longest + 1):
                if k + j > n:
                    break
                s = c[k + j] - c[k]
                top, tail = table[j, bool(s > 0)]
                p[j, k] = tail[int(np.floor(999 * s / top)) if top else 0] if top else 1.0
                if j > shortest and p[j - 1, k] >= threshold:
                    p[j, k] = threshold
        for j in range(longest, shortest - 1, -1):
            while True:
                k = int(np.argmin(p[j]))
                v, p[j, k] = p[j, k], 1
                if v >= threshold:
                    break
                if any(k + d + 1 >= n or p[j - d, k + d + 1] >= threshold for d in range(j - shortest)):
                    continue
                p[:, k : min(k + j, n - 1)] = 1
                stop, start = min(k + j + flank, n - 1), max(k - flank, 0)
                out.append((i, start, stop, round(c[stop] - c[start], 9), round(v, 9)))
    return sorted(out)


def test_caller_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    xs = [np.round(rng.normal(0, 1, 50) + 3 * (np.abs(np.arange(50) - 25) < 4), 3) for _ in range(6)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(xs)], "example_idx long, x array<double>")
    got = seqlets.call_seqlets(df, 0.1, flank=2).collect()
    assert sorted((r[0], r[1], r[2], round(r[3], 9), round(r[4], 9)) for r in got) == brute_calls(xs, 0.1, flank=2)


def test_short_examples_have_no_calls(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [])], "example_idx long, x array<double>")
    assert seqlets.call_seqlets(df).count() == 0


def motifs(seed=2, n=6):
    rng = np.random.default_rng(seed)
    return [rng.dirichlet(np.full(4, 0.2), int(k)).T for k in rng.integers(6, 11, n)]


def test_alignment_finds_itself_its_reverse_and_a_shift():
    ms = motifs()
    targets = align.Targets(ms)
    for i, m in enumerate(ms):
        p, _, offset, overlap, strand = align.align(m, targets)
        assert p.argmin() == i and strand[i] == 0 and offset[i] == 0 and overlap[i] == m.shape[1]
        p, _, _, _, strand = align.align(m[::-1, ::-1], targets)
        assert p.argmin() == i and strand[i] == 1
        p, _, offset, _, strand = align.align(m[:, 2:], targets)
        assert p.argmin() == i and strand[i] == 0 and offset[i] == 2


def plain_alignment(query, motifs):
    """(p, score, offset, overlap, strand) of each motif by loops over offsets and strands."""
    q, m = query.T, query.shape[1]
    columns = np.concatenate([x.T for x in motifs] + [x.T[::-1, ::-1] for x in motifs])
    raw = -np.linalg.norm(q[:, None, :] - columns[None], axis=2)
    low, high = raw.min(1, keepdims=True), raw.max(1, keepdims=True)
    bins = np.rint((raw - low) / np.where(high > low, high - low, 1) * align.SCORES).astype(int)
    single = np.stack([np.bincount(b, minlength=align.SCORES + 1) / len(b) for b in bins])
    size = 1 << int(m * align.SCORES + 1).bit_length()
    parts = np.fft.rfft(single, size, axis=1)
    out, at = [], np.cumsum([0] + [x.shape[1] for x in motifs] * 2)
    for t, x in enumerate(motifs):
        best = None
        for strand in (0, 1):
            own = bins[:, at[t + strand * len(motifs)] :][:, : x.shape[1]]
            for o in range(-m + 1, x.shape[1]):
                a, b = max(0, -o), min(m, x.shape[1] - o)
                total = sum(int(own[i, i + o]) for i in range(a, b))
                pdf = np.maximum(np.fft.irfft(parts[a:b].prod(0), size)[: (b - a) * align.SCORES + 1], 0)
                p = min(pdf[::-1].cumsum()[::-1][total], 1)
                if best is None or (p, -total) < (best[0], -best[1]):
                    best = p, total, o, b - a, strand
        out.append(best)
    p, *places = (np.array(c) for c in zip(*out))
    return [1 - (1 - p) ** (2 * (np.array([x.shape[1] for x in motifs]) + m - 1)), *places]


def test_alignment_equals_loops():
    rng = np.random.default_rng(6)
    ms = [rng.dirichlet(np.full(4, 0.3), int(n)).T for n in rng.integers(1, 15, 40)]
    ms += [ms[0], np.eye(4), np.round(ms[3], 1)]  # equal motifs and equal columns
    targets = align.Targets(ms)
    for m in (1, 2, 7, 12, 25, 31):
        query = rng.normal(size=(4, m)) if m % 2 else np.round(rng.dirichlet(np.ones(4), m).T, 1)
        got, want = align.align(query, targets), plain_alignment(query, ms)
        assert all(np.array_equal(x, y) for x, y in zip(got, want, strict=True))
        assert np.array_equal(align.align(query, targets, places=False)[0], want[0])
        low = np.min([align.extremes(query, align.Targets(ms[k : k + 5]))[0] for k in range(0, len(ms), 5)], 0)
        high = np.max([align.extremes(query, align.Targets(ms[k : k + 5]))[1] for k in range(0, len(ms), 5)], 0)
        parts = [align.Targets(ms[k : k + 5]) for k in range(0, len(ms), 5)]
        counts = sum(align.histogram(align.binned(query, t, low, high), t) for t in parts)
        p = np.concatenate([align.score(align.binned(query, t, low, high), t, counts)[0] for t in parts])
        assert np.array_equal(p, want[0]), "part by part"


def test_similarity_is_the_same_in_chunks(found):
    few = found.limit(12).persist()
    whole = {r[0]: r[1] for r in align.similarity(few, motifs()).collect()}
    for chunk in (1, 5, 12):
        assert {r[0]: r[1] for r in align.similarity(few, motifs(), chunk_size=chunk).collect()} == whole
    assert all(np.isfinite(v).all() and min(v) >= 0.05 for v in whole.values())
    nearest = align.similarity(few, motifs(), n_nearest=2).collect()
    assert all(len(r["nearest"]) == 2 and r["nearest"][0]["sim"] == max(whole[r["seqlet_id"]]) for r in nearest)


def test_container(spark, found, tmp_path):
    sim = found.select("seqlet_id", F.array(F.lit(1.0), F.lit(2.0)).alias("sim"))
    meta = found.select("seqlet_id", "example_idx", "start", "end")
    d = dataset.create(meta, sim, 2)
    assert [r["motif_name"] for r in d.var.orderBy("motif_idx").collect()] == ["motif_0", "motif_1"]
    with pytest.raises(ValueError):
        dataset.create(meta, sim, 2, motif_names=["one"])
    with pytest.raises(ValueError):
        dataset.create(meta, sim.limit(1), 2)
    d.save(str(tmp_path / "d"))
    back = dataset.SeqletDataset.load(spark, str(tmp_path / "d"))
    assert back.examples is None and back.obs.count() == meta.count() and back.similarity.columns == ["seqlet_id", "sim"]


def test_a_failed_save_leaves_the_version_before(spark, tmp_path):
    path = str(tmp_path / "d")
    ids = lambda d: sorted(r[0] for r in d.obs.collect())
    make = lambda n, **kw: dataset.SeqletDataset(spark.range(n).toDF("seqlet_id"), spark.range(2).toDF("motif_idx"), **kw)
    with pytest.raises(FileNotFoundError):
        dataset.SeqletDataset.load(spark, path)
    assert make(3).save(path) == 1
    bad = spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("seqlet_id"))
    with pytest.raises(Exception, match="lost"):
        make(5, similarity=bad).save(path)
    assert ids(dataset.SeqletDataset.load(spark, path)) == [0, 1, 2]
    assert make(4).save(path) == 2
    (tmp_path / "d/manifests/00000002/_SUCCESS").unlink()  # as if the manifest's writer had died
    assert ids(dataset.SeqletDataset.load(spark, path)) == [0, 1, 2]
    assert make(6).save(path) == 3 and ids(dataset.SeqletDataset.load(spark, path)) == list(range(6))
    assert ids(dataset.SeqletDataset.load(spark, path, 1)) == [0, 1, 2]
    dataset.prune(spark, path)
    assert ids(dataset.SeqletDataset.load(spark, path)) == list(range(6))
    with pytest.raises(FileNotFoundError):
        dataset.SeqletDataset.load(spark, path, 1)


def test_patterns(spark, examples, found):
    obs = found.withColumn("leiden", F.when(F.col("start").between(12, 24), "0").otherwise("1")).withColumn("seqlet_dbd", F.lit("Ets"))
    one = obs.limit(1).withColumn("leiden", F.lit("9")).withColumn("seqlet_id", F.lit(10**6).cast("long"))
    made, instances = patterns.create_patterns(obs.unionByName(one), examples, max_n=20)
    local = made.toPandas()
    assert set(local["leiden"]) == {"0", "1"} and (local["n_seqlets"] <= 20).all() and set(local["dbd"]) == {"Ets"}
    for ppm, ic in zip(local["ppm"], local["ic"], strict=True):
        assert np.allclose([sum(r) for r in ppm], 1, atol=1e-6)
        assert min(ic) > -0.01 and max(ic) < 2.0
    assert instances.where("is_root").count() == 2
    text = made.where("leiden = '0'").select(A.consensus(F.col("ppm")).alias("c")).first()["c"]
    assert "GGAA" in text or "TTCC" in text
    with pytest.raises(ValueError):
        patterns.sort_patterns(made, "colour")


def plain_leiden(edges: np.ndarray, n: int, resolution: float = 1.0, seed: int = 0, weights: np.ndarray | None = None) -> np.ndarray:
    """Communities of an undirected graph by modularity with a resolution (Traag et al. 2019): local moves, refinement
    inside communities, aggregation, until nothing moves.  Labels by size, descending."""
    rng = np.random.default_rng(seed)
    w = np.ones(len(edges)) if weights is None else weights
    pairs: dict[tuple[int, int], float] = {}
    loops = np.zeros(n)
    for (a, b), x in zip(edges.tolist(), w.tolist(), strict=True):
        if a != b:
            pairs[min(a, b), max(a, b)] = pairs.get((min(a, b), max(a, b)), 0.0) + x
        elif weights is not None:  # what lies inside a node of a graph of communities
            loops[a] += x
    graph: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), x in pairs.items():
        graph[a][b] = graph[b][a] = x
    members, total = np.arange(n), 2 * (sum(pairs.values()) + loops.sum()) or 1.0

    def move(graph, loops, labels, inside=None):
        degree = np.array([sum(g.values()) for g in graph]) + 2 * loops
        mass = np.bincount(labels, degree, len(graph))
        queue, waiting = list(rng.permutation(len(graph))), set(range(len(graph)))
        moved = False
        while queue:
            v = int(queue.pop())
            waiting.discard(v)
            to: dict[int, float] = {}
            for u, x in graph[v].items():
                if inside is None or inside[u] == inside[v]:
                    to[labels[u]] = to.get(labels[u], 0.0) + x
            here = labels[v]
            mass[here] -= degree[v]
            gain = lambda c: to.get(c, 0.0) - resolution * degree[v] * mass[c] / total
            best = max(sorted({here, *to}), key=lambda c: (gain(c), c == here))
            if gain(best) <= gain(here) + 1e-12:
                best = here
            mass[best] += degree[v]
            if best != here:
                labels[v], moved = best, True
                for u in graph[v]:
                    if labels[u] != best and u not in waiting:
                        waiting.add(u)
                        queue.insert(0, u)
        return moved

    start = np.arange(n)
    while True:
        labels = start.copy()
        moved = move(graph, loops, labels)
        result = labels[members]
        if not moved or len(np.unique(labels)) == len(graph):
            break
        fine = np.arange(len(graph))
        move(graph, loops, fine, inside=labels)
        names, fine = np.unique(fine, return_inverse=True)
        coarse = np.zeros(len(names), int)
        coarse[fine] = labels
        bigger: list[dict[int, float]] = [{} for _ in names]
        loop2 = np.bincount(fine, loops, len(names))
        for v, g in enumerate(graph):
            for u, x in g.items():
                if fine[u] == fine[v]:
                    loop2[fine[v]] += x / 2
                else:
                    bigger[fine[v]][fine[u]] = bigger[fine[v]].get(fine[u], 0.0) + x
        members, loops = fine[members], loop2
        if len(bigger) == len(graph):
            break
        graph = bigger
        start = np.unique(coarse, return_inverse=True)[1]
    names, inverse, sizes = np.unique(result, return_inverse=True, return_counts=True)
    rank = np.empty(len(names), int)
    rank[np.lexsort((names, -sizes))] = np.arange(len(names))
    return rank[inverse]


def test_clustering_separates_groups(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 5, (3, 6))
    points = [(i, (centres[i % 3] + rng.normal(0, 0.3, 6)).tolist()) for i in range(60)]
    sim = spark.createDataFrame(points, "seqlet_id long, sim array<double>")
    obs = spark.range(60).select(F.col("id").alias("seqlet_id"))
    with pytest.warns(UserWarning):
        out = cluster.cluster_seqlets(obs, sim, ["Ets", "GATA", None, "ARID", "bZIP", "Zinc"], resolution=0.5).toPandas()
    for g in range(3):
        assert out[out["seqlet_id"] % 3 == g]["leiden"].nunique() == 1
    assert out["leiden"].nunique() == 3 and np.isfinite(out[["x", "y"]].to_numpy()).all()
    assert (out.groupby("leiden")["cluster_dbd"].nunique() <= 1).all()
    edges = cluster.knn(sim, "seqlet_id", "sim").toPandas()[["seqlet_id", "neighbor"]].to_numpy()
    sizes = [len(set(plain_leiden(edges, 60, r))) for r in (0.3, 1.0, 4.0)]
    assert sizes == sorted(sizes)
    with pytest.raises(ValueError):
        cluster.cluster_seqlets(obs, None)


def test_windows_of_patterns_at_both_edges(spark):
    """Seqlets made by hand: the window of the longest, turned on the reverse strand; outside the example, unaligned."""
    oh = np.eye(4)[[0, 1, 2, 3, 0, 0, 1, 1, 2, 2]].T
    contrib = np.arange(40.0).reshape(4, 10)
    cases = [(1, 2, 5, 1, False), (2, 2, 5, -3, False), (3, 6, 9, 2, False), (4, 4, 8, 1, True), (5, 1, 4, 0, True), (6, 6, 9, -2, True), (7, 6, 9, -1, True), (8, 5, 10, 0, False)]
    df = spark.createDataFrame([(i, i, a, b, o, r, 5, oh.tolist(), contrib.tolist()) for i, a, b, o, r in cases], "seqlet_id long, example_idx long, start int, end int, offset int, is_revcomp boolean, longest int, oh array<array<double>>, contrib array<array<double>>")
    got = {r["seqlet_id"]: r for r in patterns.aligned_instances(df).collect()}
    outside = set()
    for i, a, b, o, r in cases:
        low = b - o - 5 if r else a + o
        if low < 0 or low + 5 > 10:
            outside.add(i)
            want = [np.pad(m[:, a:b], ((0, 0), (0, 5 - (b - a)))).T for m in (oh, contrib)]
        else:
            want = [m[:, low : low + 5].T for m in (oh, contrib)]
        want = [m[::-1, ::-1] for m in want] if r else want
        assert np.array_equal(got[i]["seq_instance"], want[0]) and np.array_equal(got[i]["hypothetical"], want[1]) and np.array_equal(got[i]["contrib"], want[0] * want[1]), i
    assert outside == {2, 3, 5, 6}


def test_pattern_windows_are_as_long_as_the_longest_seqlet(examples, found):
    obs = found.withColumn("leiden", F.lit("0"))
    longest = obs.agg(F.max(F.col("end") - F.col("start"))).first()[0]
    made, instances = patterns.create_patterns(obs, examples)
    row = made.first()
    assert row["n_seqlets"] == obs.count() and len(row["ppm"]) == len(row["contrib"]) == longest
    local = instances.toPandas()
    assert np.allclose(np.mean([np.stack(m) for m in local["contrib"]], 0), np.stack(row["contrib"]))


def test_sampling_draws_what_pythons_generator_draws(spark):
    import random

    obs = spark.range(100).select((F.col("id") * 3).alias("seqlet_id"), F.when(F.col("id") < 90, "a").when(F.col("id") < 95, "b").alias("leiden")).repartition(3)
    got = patterns.sample_clusters(obs, 10).collect()
    ids = lambda c: sorted(r["seqlet_id"] for r in got if r["leiden"] == c)
    assert ids("a") == sorted(random.Random(123).sample([3 * i for i in range(90)], 10)) and len(ids("b")) == 5 and len(ids(None)) == 5


def test_unseen_bins_of_a_frozen_background(spark):
    rng = np.random.default_rng(8)
    data = [(i, rng.normal(0, 1, 30).round(3).tolist()) for i in range(4)]
    schema = "example_idx long, x array<double>"
    bg = seqlets.Background.of(spark.createDataFrame(data, schema))
    for j in (4, 9, 25):
        sums = [np.concatenate([[0], np.cumsum(x)]) for _, x in data]
        every = np.concatenate([c[j:] - c[:-j] for c in sums])
        for side in (0, 1):
            part = every[(every > 0) == bool(side)]
            top = (bg.xmax if side else bg.xmin)[j]
            bins = np.clip(np.floor(999 * part / top), 0, 999).astype(int) if top else np.zeros(0, int)
            share = np.array([1 - (bins <= b).mean() if len(bins) else 1.0 for b in range(1000)])
            if len(bins):
                assert np.allclose(bg.p[side, j, bins.min() :], share[bins.min() :]) and (bg.p[side, j, : bins.min()] == 1).all()
    new = [(9, rng.normal(0, 1, 30).round(3).tolist())]
    calls = seqlets.call_seqlets(spark.createDataFrame(new, schema), 0.2, background_table=bg).count()
    frozen = seqlets.Background(bg.shortest, bg.longest, bg.xmax, bg.xmin, bg.p)
    assert calls == len(seqlets.call_one(np.array(new[0][1]), frozen, 0.2, 0))


def test_numbers_are_distinct_under_adaptive_execution(spark):
    n = 300_000
    rows = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("p_value"), (F.col("id") % 977).alias("example_idx"), (F.col("id") % 31).alias("start"), (F.col("id") % 31 + 7).alias("end"), F.md5(F.col("id").cast("string")).alias("more"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        numbered = seqlets.with_ids(rows)
        narrow = numbered.select("seqlet_id").agg(F.count_distinct("seqlet_id"), F.min("seqlet_id"), F.max("seqlet_id")).first()
        assert tuple(narrow) == (n, 0, n - 1)
        wrong = numbered.groupBy("p_value").agg(F.min("seqlet_id").alias("a"), F.max("seqlet_id").alias("b"), F.count("*").alias("n")).where("b - a + 1 <> n").count()
        assert wrong == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_log_likelihood_as_packages_compute_it():
    from math import lgamma

    dt, tw, alpha, eta = np.array([[3.0, 1.0], [0.0, 2.0]]), np.array([[2.0, 0.0, 1.0], [0.0, 3.0, 0.0]]), 25.0, 0.1
    # By hand: of each part the last cell above zero and its row's sum, less what the prior gives every row.
    topic = lgamma(3 + eta) - lgamma(3 + 3 * eta) - 2 * (3 * lgamma(eta) - lgamma(3 * eta))
    doc = lgamma(2 + alpha) - lgamma(2 + 2 * alpha) - 2 * (2 * lgamma(alpha) - lgamma(2 * alpha))
    assert np.isclose(topics.log_likelihood(dt, tw, alpha, eta, "reference"), topic + doc)
    empty = np.vstack([tw, np.zeros((1, 3))])
    more = topics.log_likelihood(dt, empty, alpha, eta, "reference") - (topic + doc)
    assert np.isclose(more, -lgamma(3 * eta) - (3 * lgamma(eta) - lgamma(3 * eta)))
    full = sum(lgamma(c + eta) - lgamma(eta) for r in tw for c in r) + sum(lgamma(3 * eta) - lgamma(r.sum() + 3 * eta) for r in tw)
    full += sum(lgamma(c + alpha) - lgamma(alpha) for r in dt for c in r) + sum(lgamma(2 * alpha) - lgamma(r.sum() + 2 * alpha) for r in dt)
    assert np.isclose(topics.log_likelihood(dt, tw, alpha, eta), full)
    with pytest.raises(ValueError):
        topics.log_likelihood(dt, tw, alpha, eta, "other")


def test_overlaps_of_very_long_and_short_intervals(spark):
    rng = np.random.default_rng(4)
    a = [(int(rng.integers(0, 3)), int(s), int(s + rng.integers(1, 200))) for s in rng.integers(-50, 3000, 300)] + [(0, 5, 5), (1, 0, 100_000)]
    b = [(int(rng.integers(0, 3)), int(s), int(s + rng.integers(1, 90))) for s in rng.integers(0, 3000, 200)] + [(0, 0, 1_000_000), (2, 40, 40)]
    schema = "k long, start long, stop long"
    got = relational.overlap_flag(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "k").collect()
    hit = lambda x: x[2] > x[1] and any(y[0] == x[0] and y[2] > y[1] and (m := min(x[2], y[2]) - max(x[1], y[1])) > 0 and m >= 0.4 * (x[2] - x[1]) for y in b)
    assert sorted(map(tuple, got)) == sorted((*x, hit(x)) for x in a) and 0 < sum(r["found"] for r in got) < len(a)


def test_ranges_of_all_magnitudes(spark):
    bounds = [0, 1, 2, 5, 5, 700, 701, 100_000, 100_003]
    ranges = spark.createDataFrame([(f"t{i}" if i != 3 else None, a, b) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))], "name string, lo long, hi long")
    index = [*range(-2, 10), 699, 700, 701, 99_999, 100_000, 100_002, 100_003, 5]
    got = relational.range_lookup(spark.createDataFrame([(i,) for i in index], "i long"), "i", ranges, "name").collect()
    name = lambda i: next((f"t{k}" if k != 3 else None for k, (a, b) in enumerate(zip(bounds, bounds[1:])) if a <= i < b), None)
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, name(i))) for i in index)


def test_neighbours_by_the_index(spark):
    e = Q.table(spark, SF.replace("0.001", "0.1"), "embeddings").select("vec_id", Q.vector().alias("v"))
    asked = e.where("vec_id % 20 = 0")
    got = cluster.knn_index(e, "vec_id", "v", 10, queries=asked, block=64).toPandas()
    want = cluster.knn(e, "vec_id", "v", 10).where("vec_id % 20 = 0").toPandas()
    pairs = lambda d: set(zip(d["vec_id"], d["neighbor"]))
    assert len(pairs(got) & pairs(want)) >= 0.9 * len(pairs(want)) and len(want) == 10 * asked.count()
    all_cells = cluster.knn_index(e.limit(300), "vec_id", "v", 5, cells=6, probes=6, block=32).toPandas()
    exact = cluster.knn(e.limit(300), "vec_id", "v", 5).toPandas()
    assert pairs(all_cells) == pairs(exact)


def test_clustering_beyond_the_limits_of_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 8, (6, 8))
    points = [(i, (centres[i % 6] + rng.normal(0, 0.4, 8)).tolist()) for i in range(240)]
    sim = spark.createDataFrame(points, "seqlet_id long, sim array<double>")
    for name, value in (("EXACT_ROWS", 100), ("TSNE_ROWS", 120)):
        monkeypatch.setattr(cluster, name, value)
    obs = sim.select("seqlet_id")
    with pytest.warns(UserWarning):
        out = cluster.cluster_seqlets(obs, sim, ["a"] * 8, resolution=0.3).toPandas()
    assert len(out) == 240 and np.isfinite(out[["x", "y"]].to_numpy()).all()
    groups = [out[out["seqlet_id"] % 6 == g]["leiden"] for g in range(6)]
    assert all(g.nunique() == 1 for g in groups) and out["leiden"].nunique() == 6
    again = cluster.second_round(out.pipe(spark.createDataFrame).withColumn("cluster_dbd", F.when(F.col("seqlet_id") % 6 < 2, "Ets").otherwise("nan")), sim, ["a"] * 8, 0.3)
    assert again.count() == 80
    wide = sim.select(F.col("seqlet_id").cast("string").alias("region_id"), *(F.get("sim", F.lit(i)).alias(f"Topic_{i + 1}") for i in range(8)))
    assert cluster.cluster_regions(wide, 0.3).groupBy("leiden").count().count() == 6


def test_communities_of_overlapping_groups(spark):
    """As good as one sequential run, and each held together by its edges."""
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 1.6, (6, 6))
    points = [(3 * i, (centres[i % 6] + rng.normal(0, 1, 6)).tolist()) for i in range(360)]
    near = cluster.materialise(cluster.knn(spark.createDataFrame(points, "id long, v array<double>"), "id", "v"), "near")
    edges = near.toPandas()[["id", "neighbor"]].to_numpy() // 3
    found = cluster.materialise(cluster.communities(near, "id", 1.0), "found")
    labels = {r["id"]: r["leiden"] for r in found.collect()}
    assert sorted(labels) == [i for i, _ in points]
    plain = spark.createDataFrame([(3 * i, str(c)) for i, c in enumerate(plain_leiden(edges, 360))], "id long, leiden string")
    assert cluster.modularity(near, found, "id") > 0.99 * cluster.modularity(near, plain, "id")
    sizes = [sum(x == str(c) for x in labels.values()) for c in range(len(set(labels.values())))]
    assert sizes == sorted(sizes, reverse=True)
    for name in set(labels.values()):
        own = {i for i, x in labels.items() if x == name}
        seen, todo = set(), [min(own)]
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                todo += [3 * b for a, b in edges if 3 * a == i and 3 * b in own] + [3 * a for a, b in edges if 3 * b == i and 3 * a in own]
        assert seen == own, "held together"
    two = spark.createDataFrame([(1, 2), (2, 1), (5, 6), (9, 9)], "id long, neighbor long")
    assert {r["id"]: r["leiden"] for r in cluster.communities(two, "id", 1.0).collect()} == {1: "0", 2: "0", 5: "1", 6: "1"}


def test_linkage_order():
    rows = np.array([[0.0], [10.0], [0.1], [10.2], [5.0]])
    order = cluster.linkage_order(rows)
    assert sorted(order) == [0, 1, 2, 3, 4] and abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1
    assert cluster.linkage_order(np.zeros((0, 2))) == [] and cluster.linkage_order(np.zeros((1, 2))) == [0]
    with pytest.raises(ValueError):
        cluster.linkage_order(np.zeros((3000, 1)))


def test_labels_are_deduped_as_by_a_loop(spark):
    rng = np.random.default_rng(6)
    hits = [(i, int(rng.integers(0, 4)), int(s), int(s + 12), ["Ets", "GATA", None][int(rng.integers(0, 3))]) for i, s in enumerate(rng.integers(0, 400, 200))]
    df = spark.createDataFrame(hits, "seqlet_id long, example_idx long, start long, end long, cluster_dbd string")
    want = {}
    for region in range(4):
        kept = []
        for i, _, a, b, dbd in sorted((h for h in hits if h[1] == region), key=lambda h: (h[2], h[0])):
            if dbd is not None and not any(d == dbd and abs(c - (a + b) / 2) < 25 for d, c in kept):
                want[i] = 0.2 if len(kept) % 2 else -0.2
                kept.append((dbd, (a + b) / 2))
    assert {r["seqlet_id"]: r["y"] for r in plotdata.dedupe_labels(df).collect()} == want


def test_principal_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 6))
    got = cluster.pca(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>"), "id", "v", 3)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    signs = np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(1)])
    assert np.allclose(np.stack([r["pca"] for r in got.orderBy("id").collect()]), (u * s)[:, :3] * signs, atol=1e-8)


def test_known_files():
    known = [(v, s) for v, names in readers.ANNOTATED.items() for s in names]
    assert len(known) == 8 and readers.annotation_path("homo_sapiens", "v9", "d") == readers.annotation_path("hgnc", "v9", "d")
    for bad in (("chicken", "v9"), ("hgnc", "v8"), ("yeast", "v9"), ("hgnc", "v7")):
        with pytest.raises(AssertionError):
            readers.annotation_path(*bad)


def test_patterns_are_made_of_all_seqlets(spark, examples, found, monkeypatch):
    obs = found.withColumn("leiden", (F.col("seqlet_id") % 2).cast("string")).persist()
    whole = {r["seqlet_id"]: tuple(r) for r in patterns.align_instances(obs, examples).collect()}
    monkeypatch.setattr(patterns, "BLOCK", 20)
    assert {r["seqlet_id"]: tuple(r) for r in patterns.align_instances(obs, examples).collect()} == whole
    for leiden, pdf in obs.toPandas().sort_values("seqlet_id").groupby("leiden"):
        matrices = patterns._matrices([np.stack(m) for m in pdf["seqlet_matrix"]])
        targets = align.Targets(matrices)
        root = np.stack([align.align(m, targets)[0] for m in matrices]).mean(0).argmin()
        assert [i for i, r in whole.items() if r[0] == leiden and r[5]] == [pdf["seqlet_id"].iloc[root]]
        _, _, offsets, _, strands = align.align(matrices[root], targets)
        placed = patterns.find_roots(obs.withColumn("_size", F.count("*").over(Window.partitionBy("leiden"))), 20)
        assert placed.where(F.col("leiden") == leiden).first()["root_id"] == pdf["seqlet_id"].iloc[root]
        turned = {i: (r["is_revcomp"]) for r in patterns.align_instances(obs.where(F.col("leiden") == leiden), examples).collect() for i in [r["seqlet_id"]]}
        assert turned == {int(i): bool(x) for i, x in zip(pdf["seqlet_id"], strands, strict=True)}
    few = Q.table(spark, SF, "embeddings").where("label = 0").orderBy("vec_id").limit(14).persist()
    monkeypatch.setattr(Q, "table", lambda *_: few)
    wide = Q.examples_wide(spark, SF)
    size = seqlets.extract_seqlets(wide, 0.1).join(wide.select("example_idx", "leiden"), "example_idx").groupBy("leiden").count().collect()
    assert max(r["count"] for r in size) > 30
    assert {r["leiden"]: r["n_seqlets"] for r in Q.QUERIES["seqlet_patterns"](spark, SF).collect()} == {r["leiden"]: r["count"] for r in size}


def _kinds_of_seqlets(rng):
    """Lists of matrices: multiples of one column, one base at a position, general ones, few values, and copies."""
    lengths = rng.integers(4, 11, 150)
    ratios = [np.array([[0.9], [1], [0.9], [1]]) * rng.normal(size=n) for n in lengths]
    yield [m / np.abs(m).max() for m in ratios]
    yield [np.eye(4)[rng.integers(0, 4, n)].T * rng.normal(size=n) for n in lengths]
    yield [rng.normal(size=(4, n)) for n in lengths]
    yield [rng.integers(-2, 3, (4, n)) / 2 for n in lengths]
    yield ratios[:20] * 4 + [np.zeros((4, 5))] * 30


def test_columns_on_lines_are_counted_without_comparing_all(monkeypatch):
    rng = np.random.default_rng(5)
    for kind, ms in enumerate(_kinds_of_seqlets(rng)):
        targets, columns = align.Targets(ms), align.Columns(np.concatenate([m.T for m in ms]))
        query = np.concatenate([m.T for m in ms[:40]])
        low, high = columns.extremes(query)
        for got, k in ((low, 0), (high, 1)):
            assert np.array_equal(got, np.concatenate([align.extremes(m, targets)[k] for m in ms[:40]]))
        whole = [align.histogram(align.binned(m, targets, *align.extremes(m, targets)), targets) for m in ms[:40]]
        assert np.array_equal(columns.histogram(query, low, high), np.concatenate(whole))
        assert (len(columns.lines), columns.rest is None) == {0: (2, True), 1: (4, True)}.get(kind, (len(columns.lines), columns.rest is None))
    # 20 times the columns: binary searches, and hardly more comparisons.
    compared, plain = [], align._paired
    monkeypatch.setattr(align, "_paired", lambda q, p: compared.append(len(q)) or plain(q, p))
    monkeypatch.setattr(align, "_distances", None)
    for n in (3_000, 60_000):
        columns = align.Columns(np.array([[0.9, 1, 0.9, 1]]) * rng.normal(size=(n, 1)))
        query = columns.lines[0].points[:, :200].T
        compared.clear()
        columns.histogram(query, *columns.extremes(query))
        assert sum(compared) < 50 * len(query)


def test_bounds_leave_few_seqlets_to_be_aligned():
    rng = np.random.default_rng(6)
    for kind, ms in enumerate(_kinds_of_seqlets(rng)):
        targets = align.Targets(ms)
        group = bounds.Group(np.concatenate([m.T for m in ms]), targets.lengths)
        queries, p = [], []
        for m in ms:
            low, high = align.extremes(m, targets)
            bins = align.binned(m, targets, low, high)
            queries.append((m, low, high, align.histogram(bins, targets)))
            p.append(align.score(bins, targets, queries[-1][3], places=False)[0])
        p = np.array(p)
        for k in range(0, len(ms), 10):
            assert (bounds.lower_bounds(queries[k : k + 1], group) <= p[k] + bounds.SLACK).all()
        low, total = bounds.lower_bounds(queries, group), p.sum(0)
        assert (low <= total + bounds.SLACK * len(ms)).all()
        if kind < 2:
            assert (low <= total.min() + bounds.SLACK * len(ms)).sum() < 10


@pytest.mark.parametrize("first", [1, 64])
def test_roots_by_bounds_are_the_roots_of_all_against_all(spark, monkeypatch, first):
    monkeypatch.setattr(patterns, "FIRST", first)
    clusters = {str(k): ms[:60] for k, ms in enumerate(_kinds_of_seqlets(np.random.default_rng(7)))}
    rows = [(c, 100 * int(c) + i, m.tolist(), len(ms)) for c, ms in clusters.items() for i, m in enumerate(ms)]
    df = spark.createDataFrame(rows, "leiden string, seqlet_id long, seqlet_matrix array<array<double>>, _size long")
    for block in (7, 2048):
        found = {r["leiden"]: r for r in patterns.find_roots(df, block).collect()}
        for c, ms in clusters.items():
            targets = align.Targets(ms)
            root = np.round(np.stack([align.align(m, targets)[0] for m in ms]).sum(0), 9).argmin()
            assert found[c]["root_id"] == 100 * int(c) + root
            low, high = align.extremes(ms[root], targets)
            assert bytes(found[c]["low"]) == low.tobytes() and bytes(found[c]["high"]) == high.tobytes()
            assert bytes(found[c]["counts"]) == align.histogram(align.binned(ms[root], targets, low, high), targets).tobytes()


def test_topic_and_tsne_queries_do_the_whole_job(spark, monkeypatch):
    fits, sizes, real, embed = [], [], topics.fit_topics, cluster.tsne
    monkeypatch.setattr(topics, "fit_topics", lambda c, ks, **kw: fits.append((list(ks), kw)) or real(c, [2], n_iter=2))
    monkeypatch.setattr(cluster, "tsne", lambda x, **kw: sizes.append((len(x), kw)) or embed(x, iterations=2))
    Q.QUERIES["lda"](spark, SF)
    Q.QUERIES["topic_eval"](spark, SF)
    assert fits == [([4], {}), (list(topics.K_VALUES), {})]
    monkeypatch.setattr(cluster, "TSNE_ROWS", 10_000)
    ids = [r[0] for r in Q.table(spark, SF, "embeddings").select("vec_id").collect()]
    assert sorted(r["vec_id"] for r in Q.QUERIES["tsne"](spark, SF).collect()) == sorted(ids) and [n for n, _ in sizes] == [len(ids)]


def test_a_region_is_drawn_or_refused(spark):
    ones = [[1.0] * 40] * 4
    e = spark.createDataFrame([(0, ones, ones), (1, ones, ones)], readers.EXAMPLES)
    hits = spark.createDataFrame([(1, 0, "r", 5, 15, 1.0, "Ets"), (2, 0, "r", 8, 18, 0.1, None), (3, 0, "r", 31, 40, -1.0, "Ets"), (4, 9, "gone", 1, 2, 1.0, None)], "seqlet_id long, example_idx long, region_name string, start long, end long, attribution double, cluster_dbd string")
    draw = plotdata.region_contributions
    cells, shown, labels = draw(e, hits, region_name="r")
    assert cells.count() == 40 and [r["seqlet_id"] for r in shown.collect()] == [1, 3] and {r["seqlet_id"]: r["y"] for r in labels.collect()} == {1: -0.2, 3: 0.2}
    assert draw(e, hits, 0, show_unannotated=True)[1].count() == 3
    assert [(r["seqlet_id"], r["start"], r["end"]) for r in draw(e, hits, 0, zoom=(10, 35), least=0.5)[1].collect()] == [(1, 0, 5), (3, 21, 25)]
    for bad in ({}, {"example_idx": 0, "region_name": "r"}, {"example_idx": 0, "zoom": (1, None)}, {"example_idx": 0, "zoom": (-1, 4)}, {"example_idx": 0, "zoom": (4, 4)}, {"example_idx": 0, "zoom": (4, 41)}, {"region_name": "none"}, {"example_idx": 1}, {"example_idx": 7}, {"region_name": "gone"}):
        with pytest.raises(ValueError):
            draw(e, hits, **bad)
    for column in ("contrib", "oh"):
        with pytest.raises(ValueError):
            draw(e.drop(column), hits, 0)
    for column in ("cluster_dbd", "region_name"):
        with pytest.raises(ValueError):
            draw(e, hits.drop(column), region_name="r")


def held_out(fits, counts, k):
    """Mean log probability of counts under fitted topics of regions and clusters."""
    own = fits[fits.k == k]
    region = own[own.kind == "region"].pivot(index="row", columns="topic", values="prob")
    clusters = own[own.kind == "cluster"].pivot(index="row", columns="topic", values="prob")
    p = (region.loc[[r for r, _, _ in counts]].to_numpy() * clusters.loc[[c for _, c, _ in counts]].to_numpy()).sum(1)
    n = np.array([x for _, _, x in counts])
    return float((n * np.log(p)).sum() / n.sum())


def test_topics_of_shards_are_as_good_as_those_of_one_sampler(spark, monkeypatch):
    rng = np.random.default_rng(3)
    true = rng.dirichlet(np.full(30, 0.1), 5)
    tables = []
    for _ in range(2):
        tables.append([(f"r{i}", f"c{j}", int(n)) for i in range(120) for j, n in enumerate(rng.multinomial(60, np.random.default_rng(i).dirichlet(np.full(5, 0.2)) @ true)) if n])
    train, test = tables
    counts = spark.createDataFrame(train, "region_id string, cluster string, n long")
    fits = topics.fit_topics(counts, [1, 5], alpha=1.0).toPandas()
    assert set(fits.columns) == {c.split()[0] for c in topics.FITS.split(", ")} and np.isfinite(fits["log_likelihood"]).all()
    assert np.allclose(fits[fits.kind == "cluster"].groupby(["k", "topic"])["prob"].sum(), 1) and np.allclose(fits[(fits.k == 1) & (fits.kind == "region")]["prob"], 1)
    assert fits[fits.kind == "region"].groupby("k")["row"].nunique().tolist() == [120, 120]

    monkeypatch.setattr(topics, "SIDE", 1)  # the plain sampler, token by token
    regions, d = np.unique([r for r, _, _ in train], return_inverse=True)
    names, w = np.unique([c for _, c, _ in train], return_inverse=True)
    n = [x for _, _, x in train]
    dt, tw = topics.plain_gibbs(np.repeat(d, n), np.repeat(w, n), len(regions), len(names), 5, 0.2, 0.1, 150, 7)
    assert dt.sum() == tw.sum() == sum(n) and (dt >= 0).all() and (tw >= 0).all()
    plain = [(5, "region", r, t + 1, p) for r, row in zip(regions, (dt + 0.2) / (dt + 0.2).sum(1, keepdims=True)) for t, p in enumerate(row)]
    plain += [(5, "cluster", c, t + 1, p) for c, row in zip(names, ((tw + 0.1) / (tw + 0.1).sum(1, keepdims=True)).T) for t, p in enumerate(row)]
    plain = pd.DataFrame(plain, columns=["k", "kind", "row", "topic", "prob"])
    known = [x for x in test if x[1] in set(names)]
    a, b = held_out(fits, known, 5), held_out(plain, known, 5)
    assert abs(a - b) < 0.01 * abs(b) and a > held_out(fits, known, 1) + 0.1
    # The likelihood, added up over regions, is that of the whole tables of counts.
    assert abs(fits[fits.k == 5]["log_likelihood"].iloc[0] - topics.log_likelihood(dt, tw, 0.2, 0.1)) < 0.02 * abs(topics.log_likelihood(dt, tw, 0.2, 0.1))


def test_tails_are_as_long_as_targets_not_queries():
    """The nulls of a long query among short targets are those of direct convolution, over the columns that can meet."""
    rng = np.random.default_rng(9)
    targets = align.Targets([rng.random((4, n)) for n in (2, 3, 5, 3)])
    at = targets.layout(20)
    counts = rng.multinomial(500, np.full(align.SCORES + 1, 1 / (align.SCORES + 1)), 20)
    tails = align._tails(counts, at.spans, at.most)
    assert at.most == 5 and tails.shape == (len(at.spans), 5 * align.SCORES + 1)
    for row, (a, b) in zip(tails, zip(*np.divmod(at.spans, 21))):
        null = np.ones(1)
        for c in counts[a:b]:
            null = np.convolve(null, c / 500)
        assert np.allclose(row[: len(null)], null[::-1].cumsum()[::-1], atol=1e-12) and not row[len(null) :].any()


def test_calls_of_many_examples_are_those_of_each(spark, monkeypatch):
    rng = np.random.default_rng(8)
    values = [np.round(rng.normal(0, 1, n) * (1 + 3 * (rng.random(n) < 0.2)), 6) for n in [*rng.integers(0, 70, 90), *[64] * 90]]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(values)], "example_idx long, x array<double>").coalesce(1)
    bg = seqlets.Background.of(rows)
    monkeypatch.setattr(seqlets, "TOGETHER", 26 * 64 * 7)
    want = [seqlets.call_one(x, bg, 0.1, 3) for x in values]
    assert seqlets.call_all(values, bg, 0.1, 3) == want and sum(map(len, want)) > 50
    called = seqlets.call_seqlets(rows, 0.1, flank=3)
    assert sorted(map(tuple, called.collect())) == sorted((i, *c) for i, found in enumerate(want) for c in found)
    assert called.rdd.getNumPartitions() == 4  # one file's rows are dealt to all tasks


def test_tokens_of_a_cell_are_drawn_at_once(monkeypatch):
    """The work follows the pairs of region and cluster, however many tokens they hold, and draws are multinomial."""
    monkeypatch.setattr(topics, "WORK", 64)
    rng = np.random.default_rng(5)
    docs, words = np.nonzero(rng.random((40, 6)) < 0.7)
    for scale in (1, 30, 3_000_000):
        n = scale * rng.integers(1, 20, len(docs))
        dt, own = np.zeros((40, 3), np.int64), np.zeros((6, 3), np.int64)
        np.add.at(dt, (docs, 0), n)
        np.add.at(own, (words, 0), n)
        sizes, kinds = dt.sum(1), own.sum(1)
        topics.cell_gibbs(topics.Cells(docs, words, n, 3), dt, own, own.astype(float), 1.0, 0.1, 3, rng)
        assert (dt.sum(1) == sizes).all() and (own.sum(1) == kinds).all() and (dt >= 0).all() and (own[:, 1:].sum() > 0)
    weights, many = np.array([0.2, 0.0, 0.5, 0.3]), np.array([400] * 500)
    for some, more in ((many, []), (many[:0], [500] * 200)):
        drawn = topics._draw(np.repeat(weights.cumsum()[:, None], 500, 1).astype(np.float32), some, more, rng)
        size = 400 if len(some) else 200
        assert (drawn.sum(0) == size).all() and not drawn[1].any() and np.abs(drawn.mean(1) / size - weights).max() < 0.01
        assert abs(drawn[0].var() / (size * 0.2 * 0.8) - 1) < 0.3


def test_likelihood_of_shards_is_that_of_the_whole(spark):
    data = [(f"r{r:02}", f"c{c}", 1 + (r * c) % 3) for r in range(11) for c in range(6) if (r + c) % 3]
    counts = spark.createDataFrame(data, "region_id string, cluster string, n long")
    for mode in ("exact", "reference"):
        one = topics.fit_topics(counts, [1], mode=mode, n_iter=2).toPandas()["log_likelihood"].iloc[0]  # with one topic, counts are known
        dt = np.array([[sum(n for r, _, n in data if r == x)] for x in sorted({r for r, _, _ in data})], float)
        tw = np.array([[sum(n for _, c, n in data if c == x) for x in sorted({c for _, c, _ in data})]], float)
        assert np.isclose(one, topics.log_likelihood(dt, tw, 50.0, 0.1, mode)), mode
    assert topics.fit_topics(counts.limit(0), [2]).count() == 0


def test_topics(spark):
    data = [(str(r), str(c), 1 + (r + c) % 3) for r in range(12) for c in range(5) if (r + c) % 2]
    counts = spark.createDataFrame(data, "region_id string, cluster string, n long")
    a = topics.fit_topics(counts, [1, 3], n_iter=10).toPandas()
    b = topics.fit_topics(counts, [1, 3], n_iter=10).toPandas()
    key = ["k", "kind", "row", "topic"]
    assert list(a.columns) == list(b.columns)
    assert np.allclose(a.sort_values(key)["prob"], b.sort_values(key)["prob"], atol=1e-10)
    assert np.allclose(a[(a.k == 1) & (a.kind == "region")]["prob"], 1)
    assert np.allclose(a[a.kind == "region"].groupby(["k", "row"])["prob"].sum(), 1, atol=1e-5)
    assert np.allclose(a[a.kind == "cluster"].groupby(["k", "topic"])["prob"].sum(), 1, atol=1e-5)
    with pytest.raises(ValueError):
        topics.count_table(counts)
    other = topics.fit_topics(counts, [3], n_iter=10, shards=2).toPandas()
    assert len(other) == len(a[a.k == 3])


def test_mode_prefers_the_smallest_and_ignores_null(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", None), ("a", None), ("b", None)], "k string, v string")
    assert {r["k"]: r["mode"] for r in relational.mode_smallest(df, ["k"], "v").collect()} == {"a": "x", "b": None}


def test_motif_files(spark, tmp_path):
    (tmp_path / "m.1.cb").write_text(">one\n1\t1\t2\t0\n0\t0\t0\t4\n>two\n1 0 0 0\n")
    (tmp_path / "m.2.cb").write_text(">one\n0 2 0 0\n")
    (tmp_path / "bad.cb").write_text("no header\n")
    got = {r["motif_name"]: r for r in readers.read_motifs(spark, str(tmp_path)).collect()}
    assert set(got) == {"one", "two"} and got["one"]["cluster_name"] == "m.2" and got["one"]["ppm"] == [[0.0], [1.0], [0.0], [0.0]]
    assert readers.read_motifs(spark, str(tmp_path), ["two", "none"]).count() == 1
    with pytest.raises(ValueError):
        readers.parse_motifs("x")
    with pytest.raises(FileNotFoundError):
        readers.read_motifs(spark, str(tmp_path / "absent")).count()
    with pytest.raises(AssertionError):
        readers.annotation_path("yeast")


def test_arrays_bed_and_sequences(spark, tmp_path):
    np.savez(tmp_path / "T_cell.npz", np.ones((3, 4, 5)))
    np.savez(tmp_path / "B_cell.npz", np.zeros((2, 4, 5)))
    assert readers.read_npz(spark, str(tmp_path)).where("contrib[0][0] = 1").agg(F.min("example_idx")).first()[0] == 2
    files = [str(p) for p in tmp_path.glob("*.npz")]
    assert [tuple(r) for r in readers.cell_type_mapping(spark, files, "{cell_type}_cell.npz").orderBy("lo").collect()] == [("B", 0, 2), ("T", 2, 5)]
    with pytest.raises(ValueError):
        readers.cell_type_mapping(spark, files, "x{cell_type}")
    (tmp_path / "a.bed").write_text("chr1 5 9 x\nchr1\t0\t4\n")
    bed = readers.read_bed(spark, str(tmp_path / "a.bed"))
    (tmp_path / "g.fa").write_text(">chr1 text\nACGT\nAC\n")
    oh = {r["start"]: r["oh"] for r in readers.fetch_one_hot(bed, readers.read_fasta(spark, str(tmp_path / "g.fa"))).collect()}
    assert [row[0] for row in oh[5]] == [0, 1, 0, 0] and not any(row[1] for row in oh[5]) and oh[0][0] == [1, 0, 0, 0]


def test_zoom_checks(spark):
    hits = spark.createDataFrame([(1, 0, 5, 15, 1.0, "Ets"), (2, 0, 8, 18, 1.0, "Ets"), (3, 0, 60, 70, -1.0, "Ets")], "seqlet_id long, example_idx long, start long, end long, attribution double, cluster_dbd string")
    got = plotdata.region_hits(hits, 100, 0, zoom=(10, 20)).collect()
    assert [(r["start"], r["end"]) for r in got] == [(0, 5), (0, 8)]
    for bad in ((None, 5), (5, 5), (-1, 5), (5, 101)):
        with pytest.raises(ValueError):
            plotdata.region_hits(hits, 100, 0, zoom=bad)
    with pytest.raises(ValueError):
        plotdata.region_hits(hits, 100, 7)
    assert {r["seqlet_id"]: r["y"] for r in plotdata.dedupe_labels(hits).collect()} == {1: -0.2, 3: 0.2}


def compare(spark, queries, sql, names):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for name in names:
        got, want = queries[name](spark, SF).toPandas(), con.sql(sql[name]).df()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols, name
        norm = lambda d: d[cols].map(lambda v: round(v, 5) if isinstance(v, float) else v).astype(str).sort_values(cols).reset_index(drop=True)  # noqa: E731, B023
        assert norm(got).equals(norm(want)), name


def test_queries_equal_their_sql(spark):
    compare(spark, Q.QUERIES, Q.SQL, [n for n in Q.SQL])


def test_entry_and_streaming(spark, tmp_path):
    import __spark_entry__ as entry

    from tessera.streaming.scoring import call_stream

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
    data = spark.createDataFrame(rows(8), readers.EXAMPLES)
    data.write.parquet(str(tmp_path / "in"))
    frozen = seqlets.Background.of(data.select("example_idx", A.project(F.col("contrib"), F.col("oh")).alias("x")))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = call_stream(stream, frozen).writeStream.format("memory").queryName("calls").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("calls").count() > 0


def test_nearest_among_copies_and_outliers(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.normal(size=(20, 8)), 40, axis=0), rng.normal(size=(300, 8)), rng.normal(size=(3, 8)) * 1e7, rng.normal(size=(60, 8)) * 1e-3 + 5e3])
    ids = rng.permutation(len(x)) * 7
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    d[np.arange(len(x)), np.arange(len(x))] = np.inf
    want = {int(i): [(int(ids[j]), d[r, j]) for j in np.lexsort((ids, d[r]))[:15]] for r, i in enumerate(ids)}
    for counts, neighbors, distances in (cluster._nearest(ids, x, ids, x, 15),):
        got = np.split(np.stack([neighbors, distances], 1), np.cumsum(counts)[:-1])
    assert {int(i): [(int(a), b) for a, b in g] for i, g in zip(ids, got, strict=True)} == want
    assert len(cluster._first_copies(np.repeat(x[:1], 5000, axis=0), 16)) == 16  # or all pairs of copies would be held at once
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, v array<double>")
    found = {}
    for r in cluster.knn(rows, "id", "v", block=400).orderBy("id", "rank").collect():
        found.setdefault(r["id"], []).append((r["neighbor"], r["distance"]))
    assert found == want


def test_a_turn_shuffles_edges_once_and_moves_as_told(spark):
    rng = np.random.default_rng(2)
    pairs = {tuple(sorted(p)) for p in rng.integers(0, 40, (150, 2)).tolist() if p[0] != p[1]}
    edges = spark.createDataFrame([(a, b, 1.0) for p in pairs for a, b in (p, p[::-1])], "a long, b long, w double").persist()
    near = {}
    for p in pairs:
        for a, b in (p, p[::-1]):
            near.setdefault(a, set()).add(b)
    for refine in (False, True):
        nodes = [(a, float(len(n)), a if refine or a % 3 else a - a % 6, a % 2) for a, n in near.items()]
        state = spark.createDataFrame(nodes, "node long, degree double, label long, inside long")
        lists, parts = cluster._lists(edges, state, refine)
        for turn in (0, 1):
            now = state.selectExpr("*", f"{turn} AS turn")
            step = cluster._turn(lists, parts, now, 2.0 * len(pairs), 1.0, 3, refine)
            assert step._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") - cluster_parts(lists) == 1
            goes = {r["node"]: r["g"] for r in now.selectExpr("node", f"{cluster._goes('node', 3)} AS g").collect()}
            at = {a: (k, label, inside) for a, k, label, inside in nodes}
            want = {}
            for a, (k, label, inside) in at.items():
                mass = lambda t, a=a: sum(v[0] for b, v in at.items() if v[1] == t and b != a)
                met = [b for b in near[a] if not refine or (at[b][2] == inside and not goes[b])]
                gain = {t: sum(at[b][1] == t for b in met) - k * mass(t) / (2.0 * len(pairs)) for t in {label} | {at[b][1] for b in met}}
                to = min(gain, key=lambda t: (-gain[t], t))
                alone = sum(v[1] == label for v in at.values()) == 1
                want[a] = to if goes[a] and gain[to] > gain[label] + 1e-12 and (alone or not refine) else label
            got = {r["node"]: (r["label"], r["moved"]) for r in step.collect()}
            assert got == {a: (t, t != at[a][1]) for a, t in want.items()} and any(m for _, m in got.values())
        lists.unpersist()


def cluster_parts(lists) -> int:
    """How often the plan of ``lists``, which a plan that reads it shows as well, deals rows to a number of parts."""
    return lists._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM")
