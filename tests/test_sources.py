"""Files read by ranges: arrays, motifs, sequences, signals."""

import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import relational
from tessera.sources import array_files, bigwig, readers, sequences, store


def partitions(df):
    return df.rdd.getNumPartitions()


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_arrays_by_ranges_of_rows(spark, tmp_path, save):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(37, 4, 6)).astype("f4"), rng.normal(size=(5, 4, 6))
    save(tmp_path / "a.npz", a)
    save(tmp_path / "b.npz", x=np.asfortranarray(b))
    store.register(spark)
    df = spark.read.format("npz").option("partBytes", 1000).load(str(tmp_path))
    assert partitions(df) == (4 + 1 if save is np.savez else 2), "ten rows of 96 bytes a partition; the other file is one"
    got = [r["value"] for r in df.orderBy("example_idx").collect()]
    assert np.array_equal(np.array(got), np.concatenate([a.astype(float), b]))
    assert [r["n"] for r in spark.read.format("npz_sizes").load(str(tmp_path)).orderBy("path").collect()] == [37, 5]
    np.savez(tmp_path / "c.npz", p=a, q=b)
    with pytest.raises(Exception, match="neither arr_0 nor a single array"):
        spark.read.format("npz").load(str(tmp_path / "c.npz")).count()


def test_arrays_written_and_read(spark, tmp_path):
    rows = [(f"t{i % 3}", [float(i), i / 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "cell string, x array<double>")
    readers.write_npz(df, str(tmp_path / "out"), "cell")
    assert sorted(p.name for p in (tmp_path / "out").glob("*.npz")) == ["t0.npz", "t1.npz", "t2.npz"]
    back = spark.read.format("npz").load(str(tmp_path / "out"))
    assert sorted(r["value"] for r in back.collect()) == sorted(r[1] for r in rows)
    assert sorted(r[0] for r in back.select("example_idx").collect()) == list(range(20))
    ranges = readers.cell_type_mapping(spark, str(tmp_path / "out"), "t{cell_type}.npz").orderBy("lo")
    assert [tuple(r) for r in ranges.collect()] == [("0", 0, 7), ("1", 7, 14), ("2", 14, 20)]
    named = readers.cell_type_mapping(spark, {"late": str(tmp_path / "out/t2.npz"), "early": str(tmp_path / "out/t0.npz")}).orderBy("lo")
    assert [tuple(r) for r in named.collect()] == [("late", 0, 6), ("early", 6, 13)]
    with pytest.raises(FileNotFoundError):
        readers.cell_type_mapping(spark, {"none": str(tmp_path / "none.npz")})


def test_motif_names_reach_the_parser(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"f{k}.cb").write_text(f">a{k}\n1 1 0 0\n>shared\n{k} 1 0 0\n")
    (tmp_path / "bad.cb").write_text(">a9\n1 1\n")
    got = readers.read_motifs(spark, str(tmp_path), ["a1", "shared", "unknown"])
    assert {r["motif_name"]: r["cluster_name"] for r in got.collect()} == {"a1": "f1", "shared": "f4"}
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        got.explain("formatted")
    assert "PushedFilters: [In(motif_name, [a1,shared,unknown])]" in plan.getvalue()
    reader = spark.read.format("motif_files").option("filesPerPartition", 2).load(str(tmp_path))
    assert partitions(reader) == 3
    assert reader.where("cluster_name = 'f2'").count() == 2


def fasta(tmp_path, records, line):
    text = "preamble\n"
    for name, bases in records:
        text += f">{name} about it\n" + "".join(bases[k : k + line] + "\r\n" for k in range(0, len(bases), line))
    (tmp_path / "g.fa").write_text(text, newline="")
    return str(tmp_path / "g.fa")


@pytest.mark.parametrize("line", [7, 10**9])
def test_sequences_in_chunks(spark, tmp_path, line):
    rng = np.random.default_rng(5)
    records = [(f"chr{k}", "".join(rng.choice(list("ACGT"), n))) for k, n in enumerate([1000, 0, 64, 63, 65, 1, 777])]
    path = fasta(tmp_path, records, line)
    for part in (211, 1 << 20):
        chunks = sequences.read_fasta(spark, path, width=64, part_bytes=part)
        got = {}
        for r in chunks.orderBy("chrom", "chunk").collect():
            assert len(r["bases"]) <= 64 and r["chunk"] == len(got.get(r["chrom"], "")) // 64
            got[r["chrom"]] = got.get(r["chrom"], "") + r["bases"]
        assert got == {n: b for n, b in records if b}, part
    known = dict(records)
    asked = [(i, f"chr{int(rng.integers(0, 8))}", int(s), int(s) + int(w)) for i, (s, w) in enumerate(zip(rng.integers(-40, 1020, 60), rng.integers(0, 150, 60)))]
    asked += [(100, "chr0", 60, 70), (101, "chr0", 60, 70), (102, "chr0", -5, -2), (103, "chr9", 3, 8)]
    regions = spark.createDataFrame(asked, "id long, chrom string, start long, stop long")
    text = {r["id"]: r["sequence"] for r in sequences.fetch(regions, chunks, width=64).collect()}
    want = {i: "".join(known.get(c, "")[p] if 0 <= p < len(known.get(c, "")) else "N" for p in range(s, e)) for i, c, s, e in asked}
    assert text == want
    wide = sequences.fetch(regions.where("id = 100"), chunks, width=64)
    assert text[100] == known["chr0"][60:70] and wide.count() == 1, "a region over the edge of two chunks"


def test_headers_longer_than_what_is_read_at_a_time(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">a " + "x" * 3000 + "\nAC\n>b" + "\nGT\n" + ">c\n" + "T" * 200_000 + "\n>d\nA")
    for part in (2000, 65_536, 1 << 20):
        rows = sequences.read_fasta(spark, str(tmp_path / "g.fa"), width=1 << 20, part_bytes=part).collect()
        assert {r["chrom"]: r["bases"] for r in rows} == {"a": "AC", "b": "GT", "c": "T" * 200_000, "d": "A"}


@pytest.mark.parametrize("kind", [bigwig.BED_GRAPH, bigwig.VARIABLE_STEP, bigwig.FIXED_STEP])
def test_signal_files(spark, tmp_path, kind):
    rng = np.random.default_rng(kind)
    rows = []
    for k in range(300):  # more names than a node has children
        n = 2500 if k == 7 else 3
        starts = 10 * np.arange(n) if kind == bigwig.FIXED_STEP else np.cumsum(rng.integers(5, 30, n))
        rows.append((f"chr{k}", starts, starts + 5, rng.normal(size=n).astype("f4").astype(float)))
    for compress in (True, False):
        (tmp_path / "s.bw").write_bytes(bigwig.encode(rows, kind, items=4, compress=compress))
        store.register(spark)
        df = spark.read.format("bigwig").option("blocksPerPartition", 100).load(str(tmp_path / "s.bw"))
        assert partitions(df) > 5
        want = sorted((c, int(s), int(e), float(v)) for c, ss, es, vs in rows for s, e, v in zip(ss, es, vs))
        assert sorted(map(tuple, df.collect())) == want
        part = df.where("chrom = 'chr7' AND start < 5000 AND stop > 4000")
        assert sorted(map(tuple, part.collect())) == [r for r in want if r[0] == "chr7" and r[1] < 5000 and r[2] > 4000]
    with open(tmp_path / "s.bw", "rb") as f:
        at = bigwig.layout(f)
        numbers = {n: k for k, (n, _) in bigwig.chromosomes(f, at).items()}
        assert len(bigwig.blocks(f, at, {numbers["chr7"]}, 4000, 5000)) < len(bigwig.blocks(f, at, {numbers["chr7"]})) < len(bigwig.blocks(f, at))
    with pytest.raises(Exception, match="not a bigWig"):
        (tmp_path / "x.bw").write_bytes(b"0" * 100)
        spark.read.format("bigwig").load(str(tmp_path / "x.bw")).count()


def test_signal_means_from_files(spark, tmp_path):
    rng = np.random.default_rng(8)
    signal = spark.createDataFrame([(f"c{k % 3}", 10 * k, 10 * k + int(rng.integers(1, 10)), float(np.float32(rng.normal()))) for k in range(3000)], "chrom string, start long, stop long, value double")
    readers.write_signal(signal, str(tmp_path / "out"))
    spans = spark.createDataFrame([(i, f"c{i % 4}", int(s), int(s) + 200) for i, s in enumerate(rng.integers(0, 30_000, 50))], "seqlet_id long, chrom string, start long, stop long")
    mean = lambda table: {r["seqlet_id"]: r["signal"] for r in relational.signal_mean(spans, table, 10, 1000).collect()}
    a, b = mean(readers.read_signal(spark, str(tmp_path / "out"))), mean(signal)
    assert a.keys() == b.keys() and all(x == b[k] or abs(x - b[k]) < 1e-9 for k, x in a.items() if x is not None)
    assert {r[0] for r in readers.read_signal(spark, str(tmp_path / "out"), ["c1"]).select("chrom").distinct().collect()} == {"c1"}
    assert array_files.store is store
