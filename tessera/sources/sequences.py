"""Sequences of FASTA files as a table of chunks, whatever the lengths of records and lines.

Files are read by ranges of bytes.  A range yields the bases of the records in it in pieces; those before its first header
belong to the record that an earlier range began.  Where that record stands follows from a row per range, so the pieces get
their positions and are cut to chunks of ``WIDTH`` bases, one row each.  A chromosome is thousands of rows, and a region reads
those it touches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tessera.functions import arrays as A
from tessera.shared import materialise
from tessera.sources import store

WIDTH = 1 << 16
#: Bytes read at a time, the most that a piece holds, and the longest header line.
STEP, HEADER = 1 << 16, 1 << 16
PIECES = "path string, part long, record long, name string, at long, bases string"
BLANK = b" \t\r\n\v\f"


@dataclass
class Range(InputPartition):
    place: store.Place
    part: int
    lo: int
    hi: int


class FastaReader(DataSourceReader):
    def __init__(self, options):
        self.places, self.part_bytes = store.files(options["path"]), int(options.get("partBytes", store.PART_BYTES))

    def partitions(self):
        return [Range(p, k, lo, min(lo + self.part_bytes, p.size)) for p in self.places for k, lo in enumerate(range(0, p.size, self.part_bytes))]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        with store.reading(part.place) as f:
            for row in scan(f, part.lo, part.hi):
                rows.append((part.place.path, part.part, *row))
                if len(rows) == 64:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in PIECES.split(", ")])


def scan(f, lo: int, hi: int) -> Iterator[tuple[int, str | None, int, str]]:
    """(record, name, at, bases) of the bytes lo .. hi - 1: record 0 is the one that began before; at counts its bases from lo
    on.  A header belongs to the range that it begins in."""
    back = min(lo, HEADER)
    f.seek(lo - back)
    before = f.read(back)
    line = before[before.rfind(b"\n") + 1 :]
    at_start = lo == 0 or before.endswith(b"\n")
    inside = line.startswith(b">") and (len(line) < back or back == lo)  # lo is in a header line
    record, name, at = 0, None, 0
    while lo < hi:
        block = f.read(min(STEP, hi - lo))
        if not block:
            return
        lo += len(block)
        pos = 0
        if inside:
            end = block.find(b"\n")
            if end < 0:
                continue
            pos, inside, at_start = end + 1, False, True
        while pos < len(block):
            if at_start and block[pos : pos + 1] == b">":
                end = block.find(b"\n", pos)
                text = block[pos + 1 : end] if end >= 0 else block[pos + 1 :]
                while end < 0 and (more := f.read(256)):  # the line goes on behind the block
                    cut = more.find(b"\n")
                    text += more if cut < 0 else more[:cut]
                    end = len(block) if cut >= 0 else -1
                    lo += len(more) if cut < 0 else cut + 1
                    if cut >= 0:
                        f.seek(lo)
                found = re.match(rb"\S+", text)
                record, name, at = record + 1, (found[0].decode("utf-8", "replace") if found else ""), 0
                yield record, name, 0, ""
                pos, at_start = (len(block) if end < 0 or end == len(block) else end + 1), True
                continue
            mark = block.find(b"\n>", pos)
            stop = len(block) if mark < 0 else mark + 1
            bases = block[pos:stop].translate(None, BLANK)
            if bases:
                yield record, name, at, bases.decode("latin-1")
                at += len(bases)
            at_start = block[stop - 1 : stop] == b"\n"
            pos = stop


class FastaPieces(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta_pieces"

    def schema(self) -> str:
        return PIECES

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastaReader(self.options)


def read_fasta(spark: SparkSession, path: str, width: int = WIDTH, part_bytes: int = store.PART_BYTES) -> DataFrame:
    """(chrom, chunk, bases): chunk k of a record holds its bases from ``k * width`` on; a name has one record.

    What stands before the first header of a file belongs to no record.  A record without bases has no chunk."""
    store.register(spark)
    pieces = materialise(spark.read.format("fasta_pieces").option("partBytes", part_bytes).load(path), "fasta-pieces")
    last = F.struct("record", F.col("at") + F.length("bases"))
    ends = pieces.groupBy("path", "part").agg(F.max(last).alias("end"), F.max_by("name", "record").alias("name")).collect()  # a row per range
    begun, state = [], {}
    for path_, part, (record, upto), name in sorted(ends, key=lambda r: (r[0], r[1])):
        known, before = state.get(path_, (None, 0))
        begun.append((path_, part, known, before))
        state[path_] = (name, upto) if record else (known, before + upto)
    carried = spark.createDataFrame(begun, "path string, part long, known string, before long")
    own = F.col("record") > 0
    placed = pieces.where("bases <> ''").join(F.broadcast(carried), ["path", "part"]).select(F.when(own, F.col("name")).otherwise(F.col("known")).alias("chrom"), (F.col("at") + F.when(own, 0).otherwise(F.col("before"))).alias("at"), "bases").where("chrom IS NOT NULL")
    chunks = F.sequence(F.expr(f"at DIV {width}"), F.expr(f"(at + length(bases) - 1) DIV {width}"))
    cut = placed.select("chrom", "at", "bases", F.explode(chunks).alias("chunk")).withColumn("skip", F.greatest(F.col("chunk") * width - F.col("at"), F.lit(0)))
    cut = cut.withColumn("take", (F.col("chunk") + 1) * width - F.col("at") - F.col("skip"))
    parts = F.array_sort(F.collect_list(F.struct((F.col("at") + F.col("skip")).alias("at"), F.substring("bases", (F.col("skip") + 1).cast("int"), F.col("take").cast("int")).alias("t"))))
    return cut.groupBy("chrom", "chunk").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("bases"))


def fetch(regions: DataFrame, chunks: DataFrame, width: int = WIDTH) -> DataFrame:
    """``regions`` (chrom, start, stop, ...) with ``sequence``; positions outside their record are N.

    A region meets the chunks that it touches, two at most unless it is wider than a chunk, and takes from each what it
    needs, so what is gathered for a region is as long as it is."""
    low = F.greatest(F.col("start").cast("long"), F.lit(0))
    high = F.greatest(F.col("stop").cast("long") - 1, low)
    touched = F.sequence(F.floor(low / width), F.floor(high / width))
    asked = regions.withColumn("_row", F.monotonically_increasing_id()).withColumn("chunk", F.explode(touched))
    met = asked.join(chunks, ["chrom", "chunk"], "left")
    begin = F.greatest(low - F.col("chunk") * width, F.lit(0))
    piece = F.substring("bases", (begin + 1).cast("int"), F.greatest(F.least(F.col("stop") - F.col("chunk") * width, F.lit(width)) - begin, F.lit(0)).cast("int"))
    rows = met.select("_row", F.struct(*regions.columns).alias("_region"), F.struct("chunk", F.coalesce(piece, F.lit("")).alias("t")).alias("_piece"))
    whole = rows.groupBy("_row").agg(F.first("_region").alias("_region"), F.array_join(F.transform(F.array_sort(F.collect_list("_piece")), lambda p: p["t"]), "").alias("_inside"))
    left = F.repeat(F.lit("N"), F.least(F.greatest(-F.col("start"), F.lit(0)), F.greatest(F.col("stop") - F.col("start"), F.lit(0))).cast("int"))
    text = F.rpad(F.concat(left, "_inside"), F.greatest(F.col("stop") - F.col("start"), F.lit(0)).cast("int"), F.lit("N"))
    return whole.select("_region.*", "_inside").select(*regions.columns, text.alias("sequence"))


def fetch_one_hot(regions: DataFrame, chunks: DataFrame, width: int = WIDTH) -> DataFrame:
    """(4, L) one-hot of regions; bases outside their record are zero columns."""
    return fetch(regions, chunks, width).withColumn("oh", A.one_hot(F.col("sequence"))).drop("sequence")
