"""Readers and writers: motif files, annotation tables, arrays, intervals, sequences, and the registry of known files."""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.sources import motif_files, store
from tessera.sources.sequences import fetch_one_hot, read_fasta  # noqa: F401

EXAMPLES = "example_idx bigint, contrib array<array<double>>, oh array<array<double>>"


def parse_motifs(text: str) -> list[tuple[str, list[list[float]]]]:
    """(name, (4, L) matrix) of each motif.  Each position is divided by its sum; a zero sum gives NaN."""
    return [(name, motif_files.probabilities(m)) for name, m in motif_files.sections(text)]


def read_motifs(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """Motifs of all ``.cb`` files of a folder, with the file's name as cluster_name.

    Malformed files are skipped whole; of motifs with one name the one in the last file (by path) stays; unknown names in
    ``names`` are ignored, and only motifs of these names leave the parser; motif_idx follows the name.
    """
    store.register(spark)
    store.files(folder, ".cb")  # an absent folder is told now
    motifs = spark.read.format("motif_files").load(folder)
    if names is not None:
        motifs = motifs.where(F.col("motif_name").isin(names))
    last = Window.partitionBy("motif_name").orderBy(F.desc("path"), F.desc("at"))
    kept = motifs.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "path", "at")
    # A motif collection is a reference set of some ten thousand rows, so numbering it in one task is fine.
    return kept.withColumn("motif_idx", F.row_number().over(Window.orderBy("motif_name")) - 1)


def write_motifs(motifs: DataFrame, folder: str) -> None:
    """The inverse of ``read_motifs``: (motif_name, cluster_name, at, ppm) as one ``.cb`` file per cluster_name, motifs in order
    of ``at``.  Spark writes the files; the driver renames them, one per name of a reference collection."""
    spark = motifs.sparkSession
    lines = F.transform(A.transpose(F.col("ppm")), lambda r: F.concat_ws("\t", F.transform(r, lambda x: x.cast("string"))))
    text = F.concat(F.lit(">"), F.col("motif_name"), F.lit("\n"), F.array_join(lines, "\n"))
    files = motifs.groupBy("cluster_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("t")))), lambda s: s["t"]), "\n").alias("value"))
    files.repartition("cluster_name").write.partitionBy("cluster_name").text(f"{folder}/_written")
    path = spark._jvm.org.apache.hadoop.fs.Path
    top = path(f"{folder}/_written")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    for place in fs.listStatus(top):
        if place.isDirectory():
            name = place.getPath().getName().split("=", 1)[1]
            for f in fs.listStatus(place.getPath()):
                if f.getPath().getName().startswith("part-"):
                    fs.rename(f.getPath(), path(f"{folder}/{name}.cb"))
    fs.delete(top, True)


ANNOTATION_COLUMNS = {"#motif_id": "motif_id", "gene_name": "gene_name", "motif_similarity_qvalue": "motif_similarity_qvalue", "orthologous_identity": "orthologous_identity", "description": "description"}


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """S3: five of the columns of a tab-separated annotation table."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    number = {"motif_similarity_qvalue", "orthologous_identity"}
    return rows.select(*((F.col(f"`{a}`").cast("double") if b in number else F.col(f"`{a}`")).alias(b) for a, b in ANNOTATION_COLUMNS.items()))


def read_human_tf(spark: SparkSession, path: str) -> DataFrame:
    """(hgnc_symbol, dbd); a local table, nothing is fetched."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return rows.select(F.col("`HGNC symbol`").alias("hgnc_symbol"), normalise_null(F.col("DBD")).alias("dbd"))


def normalise_null(column):
    """The literal string "nan" and NaN are null."""
    return F.when(F.lower(column.cast("string")) == "nan", None).otherwise(column)


def read_npz(spark: SparkSession, contrib: str, oh: str | None = None, part_bytes: int = store.PART_BYTES) -> DataFrame:
    """Arrays of shape (n, 4, L) from npz files: key arr_0, or the only key.  Files are read by ranges of rows;
    example_idx runs through the files by path."""
    store.register(spark)

    def load(folder: str, name: str) -> DataFrame:
        return spark.read.format("npz").option("partBytes", part_bytes).load(folder).select("example_idx", F.col("value").alias(name))

    out = load(contrib, "contrib")
    return out.join(load(oh, "oh"), "example_idx") if oh else out


def write_npz(rows: DataFrame, path: str, name_column: str | None = None) -> None:
    """The inverse of ``read_npz`` for one array column: a file for each partition, or for each value of ``name_column``."""
    store.register(rows.sparkSession)
    dealt = rows.repartition(name_column) if name_column else rows
    writer = dealt.write.format("npz").mode("append")
    (writer.option("nameColumn", name_column) if name_column else writer).save(path)


def read_signal(spark: SparkSession, path: str, chroms: list[str] | None = None) -> DataFrame:
    """(chrom, start, stop, value) of bigWig files; only blocks of ``chroms`` are read."""
    store.register(spark)
    rows = spark.read.format("bigwig").load(path)
    return rows if chroms is None else rows.where(F.col("chrom").isin(chroms))


def write_signal(rows: DataFrame, path: str) -> None:
    """(chrom, start, stop, value) as bigWig files, each of some chromosomes."""
    store.register(rows.sparkSession)
    dealt = rows.select("chrom", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("value").cast("double").alias("value"))
    dealt.repartition("chrom").write.format("bigwig").mode("append").save(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """The first three fields."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("chrom"), parts[1].cast("bigint").alias("start"), parts[2].cast("bigint").alias("stop"))


def write_bed(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Tab-separated, sorted by the first two columns."""
    rows.select(*columns).orderBy(*columns[:2]).write.mode("overwrite").option("sep", "\t").csv(path)


def read_modisco(seqlets: DataFrame, examples: DataFrame) -> DataFrame:
    """Checks that each stored instance equals the slice of its example, or the slice's reverse complement."""
    joined = seqlets.join(examples.select("example_idx", "oh"), "example_idx")
    here = A.transpose(A.slice_columns(F.col("oh"), F.col("start"), F.col("end")))
    back = A.reverse_complement(here)
    ok = F.col("instance") == F.when(F.col("is_revcomp"), back).otherwise(here)
    return joined.withColumn("instance", F.when(ok, F.col("instance")).otherwise(F.raise_error(F.lit("a seqlet differs from its region")))).drop("oh")


#: The species that each version of the annotations has, and their long names.
ANNOTATED = {"v8": ["flybase"], "v9": ["flybase", "hgnc", "mgi"], "v10nr_clust": ["chicken", "flybase", "hgnc", "mgi"]}
SPECIES = {"mus_musculus": "mgi", "homo_sapiens": "hgnc", "drosophila_melanogaster": "flybase", "gallus_gallus": "chicken"}


def annotation_path(species: str = "hgnc", version: str = "v10nr_clust", folder: str | None = None) -> str:
    """Where a known annotation file lies; nothing is downloaded."""
    short = SPECIES.get(species, species)
    assert short in ANNOTATED.get(version, []), f"choose one of {[(s, v) for v, names in ANNOTATED.items() for s in names]}"
    return os.path.join(folder or os.environ.get("TESSERA_CACHE", "."), f"motifs-{version}-nr.{short}-m0.001-o0.0.tbl")


def annotation_paths(rows: DataFrame, species: str, version: str | None = None, folder: str = ".") -> DataFrame:
    """``rows`` with ``path``, that of the annotations of the species and version that two of its columns name (short
    or long names; v9 without a column); a pair that there is no file for is an error that lists those there are."""
    known = [(n, v, s) for v, names in ANNOTATED.items() for s in names for n in {s, *(long for long, short in SPECIES.items() if short == s)}]
    registry = rows.sparkSession.createDataFrame(known, "_name string, _version string, _short string")
    wanted = F.col(version) if version else F.lit("v9")
    met = rows.join(F.broadcast(registry), (F.col(species) == F.col("_name")) & (wanted == F.col("_version")), "left")
    listed = ", ".join(f"{s} {v}" for v, names in ANNOTATED.items() for s in names)
    path = F.concat(F.lit(folder + "/motifs-"), "_version", F.lit("-nr."), "_short", F.lit("-m0.001-o0.0.tbl"))
    found = F.when(F.col("_short").isNotNull(), path).otherwise(F.raise_error(F.concat(F.lit("choose one of " + listed + ", not "), F.coalesce(F.col(species), F.lit("null")))))
    return met.select(*rows.columns, found.alias("path"))


def cell_type_of(path, pattern: str):
    """the cell type in a file's name, as a column; null where the name doesn't match from its start."""
    base = F.element_at(F.split(path, "/"), -1)
    return F.nullif(F.regexp_extract(base, "^" + pattern.replace("{cell_type}", "(.+?)"), 1), F.lit(""))


def cell_type_mapping(spark: SparkSession, files: dict[str, str] | list[str] | str, pattern: str | None = None) -> DataFrame:
    """(cell_type, lo, hi) from npz files: a dict keeps its order, a list or a folder is sorted by path.

    In ``pattern`` the text {cell_type} stands for the name; it is matched from the start of the file's name, its other
    characters as a regular expression.  Only the files' headers are read, by tasks.
    """
    import re

    store.register(spark)
    if isinstance(files, dict):
        named = list(files.items())
        for _, path in named:
            store.files(path)
        places = [store.files(path)[0] for _, path in named]
    else:
        places = store.files(files, ".npz") if isinstance(files, str) else [store.files(p)[0] for p in sorted(files)]
        named = []
        for place in places:
            m = re.match((pattern or "{cell_type}.npz").replace("{cell_type}", "(.+?)"), place.name)
            if not m:
                raise ValueError(f"{place.name} does not match {pattern}")
            named.append((m[1], place.path))
    order = spark.createDataFrame([(k, name, place.path) for k, ((name, _), place) in enumerate(zip(named, places, strict=True))], "at int, cell_type string, path string")
    folders = sorted({place.root for place in places})
    sizes = functools.reduce(DataFrame.unionByName, (spark.read.format("npz_sizes").load(f) for f in folders)).distinct()
    # One row per file, so adding them up in one task is fine.
    upto = F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return order.join(sizes, "path").select("cell_type", (upto - F.col("n")).alias("lo"), upto.alias("hi"))
