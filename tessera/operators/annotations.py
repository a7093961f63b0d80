"""Motif annotations: filters, categories, and the DNA-binding domain of each motif."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.relational import mode_smallest

COLUMNS = {"direct": "Direct_annot", "similar": "Motif_similarity_annot", "orthologous": "Orthology_annot", "both": "Motif_similarity_and_Orthology_annot"}
#: Fixed value: the description of a direct annotation.
DIRECT = "gene is directly annotated"


def category(description: Column) -> Column:
    """Which of the four columns a row belongs to; other descriptions belong to none."""
    similar, orthologous = description.contains("similar"), description.contains("orthologous")
    return F.when(description == DIRECT, "direct").when(similar & orthologous, "both").when(similar, "similar").when(orthologous, "orthologous")


def categorise(rows: DataFrame, fdr: float = 0.001, identity: float = 0.0) -> DataFrame:
    """One row per motif with four columns of names, joined by ", " in ascending order."""
    good = rows.where((F.col("motif_similarity_qvalue") <= fdr) & (F.col("orthologous_identity") >= identity))
    named = good.withColumn("_kind", category(F.col("description"))).where("_kind IS NOT NULL")
    names = lambda k: F.nullif(F.array_join(F.sort_array(F.collect_set(F.when(F.col("_kind") == k, F.col("gene_name")))), ", "), F.lit(""))
    return named.groupBy("motif_id").agg(*(names(k).alias(c) for k, c in COLUMNS.items()))


def motif_to_dbd(annotations: DataFrame, factors: DataFrame) -> DataFrame:
    """The most frequent domain of a motif's factors; a factor named in two columns counts twice."""
    names = annotations.select("motif_id", F.explode(F.split(F.concat_ws(", ", *COLUMNS.values()), ", ")).alias("gene_name")).where("gene_name <> ''")
    known = names.join(factors.select(F.col("hgnc_symbol").alias("gene_name"), "dbd"), "gene_name").where("dbd IS NOT NULL")
    return mode_smallest(known, ["motif_id"], "dbd", "dbd")


def attach(motifs: DataFrame, annotations: DataFrame, dbd: DataFrame, lookup: str = "member") -> DataFrame:
    """Annotations and domain of motifs, by their own name or by that of their file."""
    key = {"member": "motif_name", "cluster": "cluster_name"}[lookup]
    out = motifs.join(annotations.withColumnRenamed("motif_id", key), key, "left")
    return out.join(dbd.withColumnRenamed("motif_id", key), key, "left")
