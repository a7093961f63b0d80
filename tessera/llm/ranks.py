"""Places of rows in their groups, and dense numbers of groups, over tables whose groups may hold any share of the rows.

Rows are sorted by ranges of (group, order), so a group with a third of all rows lies over as many tasks as it needs.  Each
task numbers the rows of its range as they stream by; what the ranges before it hold is added from one row per range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.llm import core


def _new_groups(batch: pa.RecordBatch, names: list[str], last: tuple | None) -> np.ndarray:
    """Where a row's group differs from the row before; ``last`` is that of the batch before."""
    out = np.zeros(batch.num_rows, bool)
    for name in names:
        c = batch.column(name)
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        out[1:] |= differ.to_numpy(zero_copy_only=False)
    out[0] = last is None or last != tuple(batch.column(n)[0].as_py() for n in names)
    return out


def _number(names: list[str]):
    def run(batches):
        last, rank, at = None, -1, 0  # of the row before; at: rows of its group so far
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = _new_groups(batch, names, last)
            ranks, index = rank + np.cumsum(new), np.arange(n)
            begin = np.maximum.accumulate(np.where(new, index, -1))
            places = np.where(begin < 0, at + index, index - begin)
            last, rank, at = tuple(batch.column(c)[n - 1].as_py() for c in names), int(ranks[-1]), int(places[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks), pa.array(places)], [*batch.schema.names, "_rank", "_at"])

    return run


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, int, str]:
    """``df`` with _group, the dense number of each group in order of ``group``, and _at, the place of the row in its group in
    order of ``order``, both from 0, nulls first; the number of groups; and the path of the table, for ``core.drop``.

    Rows equal in all these columns are placed in any order, the same for all readers of the result."""
    core.small_batches(df.sparkSession)
    keys = [*map(F.col, group), *map(F.col, order), F.monotonically_increasing_id()]
    dealt = df.repartitionByRange(core.tasks(df.sparkSession), *keys[:-1], keys[-1].alias("_tie")).sortWithinPartitions(*keys[:-1])
    schema = StructType([*df.schema.fields, StructField("_part", IntegerType()), StructField("_rank", LongType()), StructField("_at", LongType())])
    kept, path = core.stored(dealt.withColumn("_part", F.spark_partition_id()).mapInArrow(_number(group), schema), name)
    place = F.struct("_rank", "_at")
    ends = kept.groupBy("_part").agg(F.min_by(F.struct(*group), place).alias("first"), F.max_by(F.struct(*group), place).alias("last"), F.max(place).alias("end"))
    offsets, total, before, run = [], 0, None, 0
    for part, first, last, (rank, at) in sorted(ends.collect(), key=lambda r: r[0]):  # a row per range
        same = before is not None and first == before
        offsets.append((part, total - same, run if same else 0))
        run = at + 1 + (run if same and rank == 0 else 0)
        total += rank + 1 - same
        before = last
    added = df.sparkSession.createDataFrame(offsets, "_part int, _groups long, _run long")
    out = kept.join(F.broadcast(added), "_part")
    at = F.col("_at") + F.when(F.col("_rank") == 0, F.col("_run")).otherwise(0)
    return out.select(*df.columns, (F.col("_rank") + F.col("_groups")).alias("_group"), at.alias("_at")), total, path
