"""Shared kernels: vectorised text scanning over code points, session helpers, blobs.

Texts are handled in bounded groups.  A group is one flat array of code points plus the offset of each document, so
that word and pre-token boundaries, hashes and counts are NumPy passes and not Python loops.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points handled together; a longer document makes a group of its own.
GROUP_CHARS = 1_000_000
#: Rows and bytes of an Arrow batch between the JVM and Python; a longer document makes a batch of its own.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20

U64 = np.uint64


# ---------------------------------------------------------------- session

def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    The setting is read from the session.  Only a local session without it (tests) falls back to a folder of its own;
    a cluster without it is refused, as machine-local folders are not shared there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _local_base()
    path = f"{base.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


#: Folders that this driver has made and not removed.
_MADE: list[str] = []


def clean(spark: SparkSession) -> None:
    """Removes all intermediate tables of this driver; results that were read from them must have been written before."""
    for path in list(_MADE):
        drop(spark, path)


@functools.cache
def _local_base() -> str:
    import atexit

    path = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return "file://" + path


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """While a table is written: its shuffle files go as soon as it is complete, as nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes ``df`` as a table in the shared folder and reads it back: the lineage is cut and survives executors.  The path
    is for ``drop`` when nothing will read the table again."""
    path = shared_dir(df.sparkSession, name)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``stored`` for a table that the result is read from; ``clean`` removes it."""
    return stored(df, name)[0]


#: Database of bucketed tables while a job needs them.
SCRATCH = "tessera_scratch"


@contextlib.contextmanager
def bucketed(df: DataFrame, key: str, name: str) -> Iterator[DataFrame]:
    """``df`` as a table bucketed by ``key``, so that what is grouped by the key can meet it without moving it; removed at
    the end, with its files."""
    spark = df.sparkSession
    table, path = f"{SCRATCH}.{name}_{uuid.uuid4().hex}", shared_dir(spark, name)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {SCRATCH}")
    with tidy(spark):
        df.write.bucketBy(tasks(spark), key).option("path", path).format("parquet").saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        drop(spark, path)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def tasks(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, whatever else (clashing names included) the table carries."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of ``docs`` has them."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def groups(batch: pa.RecordBatch, limit: int = GROUP_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of a batch in groups of about ``limit`` code points."""
    ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    lo, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield ids[lo:i], texts[lo:i]
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield ids[lo:], texts[lo:]


def give_back() -> None:
    """Returns memory that arrays have freed to the system, where the C library can: a worker that waits for its next task
    should not keep what its last one needed most."""
    trim = _trimmer()
    if trim is not None:
        trim(0)


@functools.cache
def _trimmer():
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", None)


# ---------------------------------------------------------------- code points

def code_points(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat uint32 code points and the offsets (n + 1) of the texts in them."""
    texts = list(texts)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), offsets


def lower_ascii(cps: np.ndarray) -> np.ndarray:
    return cps + ((cps >= 65) & (cps <= 90)).astype(np.uint32) * np.uint32(32)


def is_blank(cps: np.ndarray) -> np.ndarray:
    """The separators of the contracts' words: U+0020 and U+0009 to U+000D."""
    return (cps == 32) | ((cps >= 9) & (cps <= 13))


def words(cps: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words of all texts, and the text each belongs to.  ``solid``: which code points make words."""
    solid = ~is_blank(cps) if solid is None else solid
    edge = np.zeros(len(cps), bool)
    inner = offsets[:-1][offsets[:-1] < len(cps)]
    edge[inner] = True  # a word never crosses into the next text
    before = np.zeros(len(cps), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge))
    after = np.zeros(len(cps), bool)
    after[:-1] = solid[1:] & ~edge[1:]
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends - starts, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_RANDOM = mix(np.arange(0x3000, dtype=U64))
_BASE = U64(0x9E6C63D0876A9A47)


#: The inverse of _BASE modulo 2**64.
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
#: Code points that are hashed together, and of a slice that is digested by itself.
HASH_CHARS, LONG_CHARS = 1 << 20, 32


@functools.lru_cache(2)
def _powers(base: U64) -> np.ndarray:
    out = np.full(HASH_CHARS, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _random(c: np.ndarray) -> np.ndarray:
    return _RANDOM[c] if len(c) and c.max() < len(_RANDOM) else mix(c.astype(U64))


def chunks(starts: np.ndarray, lengths: np.ndarray, limit: int = HASH_CHARS) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of ascending slices that lie within ``limit`` positions; a longer slice is a run of its own."""
    ends, i = starts + lengths, 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + limit, "right")), i + 1)
        yield i, j
        i = j


def hash_slices(cps: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices that do not overlap, in ascending order; equal slices have equal hashes.

    A slice's polynomial is a difference of running sums, shifted back by its place; memory is bounded by HASH_CHARS.  Modulo
    2**64 such polynomials of long slices in few letters are equal by rule (Thue-Morse words), whatever the base: slices of
    LONG_CHARS or more have a BLAKE2 digest instead."""
    sums = np.zeros(len(starts), U64)
    for i, j in chunks(starts, lengths):
        lo, hi = int(starts[i]), int(starts[j - 1] + lengths[j - 1])
        if hi - lo > HASH_CHARS:  # one slice, a long one
            continue
        running = np.zeros(hi - lo + 1, U64)
        np.cumsum(_random(cps[lo:hi]) * _powers(_BASE)[: hi - lo], out=running[1:])
        at = starts[i:j] - lo
        # An empty slice may begin behind the last code point.
        sums[i:j] = (running[at + lengths[i:j]] - running[at]) * _powers(_INVERSE)[np.minimum(at, HASH_CHARS - 1)]
    for i in np.flatnonzero(lengths >= LONG_CHARS).tolist():
        part = np.ascontiguousarray(cps[starts[i] : starts[i] + lengths[i]], "<u4")
        sums[i] = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little")
    return mix(sums ^ (lengths.astype(U64) * U64(0xD6E8FEB86659FD93)))


def word_hashes(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and offsets (n + 1) of the texts in them."""
    cps, offsets = code_points(texts)
    starts, lengths, doc = words(cps, offsets)
    h = hash_slices(lower_ascii(cps) if lower else cps, starts, lengths)
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive values; entry i is that of the run that starts at i."""
    if len(h) < n:
        return np.zeros(0, U64)
    m = len(h) - n + 1
    out = np.zeros(m, U64)
    for k in range(n):
        out = mix(out ^ h[k : k + m]) * _BASE + U64(k)
    return mix(out)


# ---------------------------------------------------------------- blobs

def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 as byte planes of their differences: planes without content cost nothing."""
    d = np.diff(keys, prepend=U64(0)).astype("<u8") if len(keys) else np.zeros(0, "<u8")
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).reshape(-1).view("<u8"), dtype=U64)


def pack_array(a: np.ndarray) -> bytes:
    """Any numeric array by byte planes; the dtype is known to the reader."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())


def unpack_array(blob: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(dtype)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + lengths[i] - 1 for each i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)


def drop(spark: SparkSession, path: str) -> None:
    """Removes a table in the shared folder that nothing will read again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _MADE:
        _MADE.remove(path)


def bucket_slices(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds (buckets + 1) of the slices of ascending keys when the key space is cut into equal ranges."""
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], U64)
    return np.concatenate([[0], np.searchsorted(keys, edges, "left"), [len(keys)]])
