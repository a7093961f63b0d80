"""The container of a run: seqlets, motifs, examples and similarity as tables that refer to each other by id."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import annotations as N


@dataclass
class SeqletDataset:
    obs: DataFrame
    var: DataFrame
    examples: DataFrame | None = None
    similarity: DataFrame | None = None

    def save(self, path: str, compression: str = "zstd") -> int:
        """A new version, whose number it returns: one folder per table below a folder of its own, nested arrays are native.

        A manifest that names the folders is written last, and its own end marks it whole; so a save that fails half-way, or
        runs beside another, leaves the versions before as they were."""
        spark = self.obs.sparkSession
        number = max(_versions(spark, path, whole=False), default=0) + 1
        folder = f"{path}/data/{number:08d}-{uuid.uuid4().hex}"
        tables = {}
        for name in TABLES:
            table = getattr(self, name)
            if table is not None:
                tables[name] = f"{folder}/{name}"
                table.write.option("compression", compression).parquet(tables[name])
        # Two saves at once ask for one number; the second one's manifest meets the first's and fails.
        relative = {name: place.removeprefix(f"{path}/") for name, place in tables.items()}
        spark.createDataFrame([(json.dumps(relative),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifests/{number:08d}")
        return number

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SeqletDataset:
        """Reads the last whole version, or the given one, lazily; tables that were not saved are None."""
        known = _versions(spark, path)
        if not known or version is not None and version not in known:
            raise FileNotFoundError(f"{path} has no whole version" + ("" if version is None else f" {version}"))
        tables = json.loads(spark.read.text(f"{path}/manifests/{version or max(known):08d}").first()[0])
        return cls(*(spark.read.parquet(f"{path}/{tables[n]}") if n in tables else None for n in TABLES))


TABLES = ("obs", "var", "examples", "similarity")


def _versions(spark: SparkSession, path: str, whole: bool = True) -> list[int]:
    """The numbers of the versions, of those with ``whole`` manifests or of all that a save has begun to write."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    done = [s.getPath() for s in fs.listStatus(top) if not whole or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName()) for p in done)


def prune(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Removes all but the last ``keep`` whole versions, manifests first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for number in _versions(spark, path)[:-keep]:
        tables = json.loads(spark.read.text(f"{path}/manifests/{number:08d}").first()[0])
        fs.delete(hadoop(f"{path}/manifests/{number:08d}"), True)
        for place in {t.rsplit("/", 1)[0] for t in tables.values()}:
            fs.delete(hadoop(f"{path}/{place}"), True)


def create(
    seqlets: DataFrame,
    similarity: DataFrame,
    n_motifs: int,
    matrices: DataFrame | None = None,
    examples: DataFrame | None = None,
    motif_names: list[str] | None = None,
    motifs: DataFrame | None = None,
    annotations: DataFrame | None = None,
    dbd: DataFrame | None = None,
    lookup: str = "member",
) -> SeqletDataset:
    """Checks the counts and joins what is known about the motifs.

    ``seqlets`` has seqlet_id and metadata; ``matrices`` (seqlet_id, seqlet_matrix); ``motifs`` (motif_idx, motif_name,
    cluster_name, ppm).  Without any names motifs are called motif_0, motif_1 and so on and nothing is looked up.
    """
    spark = seqlets.sparkSession
    n = seqlets.count()
    if similarity.count() != n:
        raise ValueError("similarity and seqlet metadata differ in their number of seqlets")
    if matrices is not None and matrices.count() != n:
        raise ValueError("seqlet matrices and metadata differ in their number of seqlets")
    if motif_names is not None and len(motif_names) != n_motifs:
        raise ValueError("motif names and similarity differ in their number of motifs")
    if motifs is not None and motifs.count() != n_motifs:
        raise ValueError("motif collection and similarity differ in their number of motifs")
    obs = seqlets.join(matrices, "seqlet_id", "left") if matrices is not None else seqlets
    if motifs is not None:
        var = motifs
    else:
        names = motif_names or [f"motif_{i}" for i in range(n_motifs)]
        var = spark.createDataFrame([(i, m, m) for i, m in enumerate(names)], "motif_idx int, motif_name string, cluster_name string")
    if (motifs is not None or motif_names is not None) and annotations is not None and dbd is not None:
        var = N.attach(var, annotations, dbd, lookup)
    elif (motifs is not None or motif_names is not None) and dbd is not None:
        key = {"member": "motif_name", "cluster": "cluster_name"}[lookup]
        var = var.join(dbd.withColumnRenamed("motif_id", key), key, "left")
    return SeqletDataset(obs, var, examples, similarity)
