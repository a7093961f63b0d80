"""From raw documents to packed sequences in four stages: quality rules, line dedup, near duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a DataFrame, which is written as
Parquet in the shared folder and reread as the next one's documents.

Other columns pass through all stages but the last, whatever their names; an empty table gives an empty result.  What null
ids and texts, ties and repeated rows give is stated at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import core, jaccard_join, line_dedup, packing, quality
from tessera.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject; trusted are those labelled good and not toxic.

    A null or empty text fails the base rules and goes.  Rows are judged each by its own text, so repeated rows, and rows
    that share an id or have none, stay or go with their text; a score equal to the threshold stays."""
    return quality.filter_documents(docs, quality.trusted_ids(core.documents(spark, sf_dir, "labels")))


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that are boilerplate of their source; n_chars is that of the text left.

    Copies count as one page here: they are for the next stage, which needs their text to keep one of them.  No row goes; a
    null text stays null; rows with a null source are one source; a line at exactly the ratio stays."""
    kept = line_dedup.drop_lines(docs, F.col("source"), counts=False, copies=False)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a Jaccard similarity of 0.8: that of the smallest id,
    null ids last.  Of repeated rows one stays; rows without words or text are linked with nothing and stay."""
    return jaccard_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents left into sequences of at most 4096 tokens.  A null or empty text is its end id; repeated rows and
    rows without an id are packed each on its own; of equal lengths the earlier row goes first."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", site_lines), ("ngram_jaccard_join", near_duplicates), ("packing", pack)]

#: Tokenisation and hashed models have no SQL form; tests/llm compares each stage and run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = core.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = core.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
