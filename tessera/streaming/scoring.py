"""Scoring of newly arriving examples against a frozen background and motif collection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from tessera.functions import arrays as A
from tessera.operators.seqlets import Background, call_seqlets


def call_stream(examples: DataFrame, frozen: Background, threshold: float = 0.05, flank: int = 3) -> DataFrame:
    """Seqlets of a stream of (example_idx, contrib, oh): row by row, so it needs no state and no watermark."""
    from pyspark.sql import functions as F

    x = examples.select("example_idx", A.project(F.col("contrib"), F.col("oh")).alias("x"))
    return call_seqlets(x, threshold, frozen.shortest, frozen.longest, flank, frozen)


def score_stream(seqlets: DataFrame, motifs: list[np.ndarray], path: str, checkpoint: str):
    """Writes the similarity of each micro-batch of seqlets to ``path``; a repeated batch overwrites its own folder."""
    from tessera.operators.align import similarity

    def batch(df: DataFrame, number: int) -> None:
        similarity(df, motifs).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return seqlets.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
