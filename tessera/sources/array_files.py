"""Arrays in npz files as a source and a sink.

The header of an array says where its rows lie, so a file is read by ranges of rows, each a partition, and no task holds more
than a few megabytes of it.  Compressed arrays can only be read from their start; such a file is one partition, read in pieces.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from tessera.sources import store

#: Bytes that a task reads at a time.
STEP_BYTES = 4 << 20


@dataclass
class Header:
    """Where an array lies in its file; ``offset`` is None if its rows can't be reached by their places."""

    place: store.Place
    entry: str
    shape: tuple[int, ...]
    dtype: str
    offset: int | None

    @property
    def row_bytes(self) -> int:
        return max(int(np.prod(self.shape[1:], dtype=np.int64)) * np.dtype(self.dtype).itemsize, 1)


def _npy_header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(f)
    return (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)


def header(place: store.Place) -> Header:
    """Of the array arr_0, or the only one."""
    with store.reading(place) as f, zipfile.ZipFile(f) as z:
        names = z.namelist()
        entry = "arr_0.npy" if "arr_0.npy" in names else names[0] if len(names) == 1 else None
        if entry is None:
            raise ValueError(f"{place.path} has neither arr_0 nor a single array")
        info = z.getinfo(entry)
        if info.compress_type != zipfile.ZIP_STORED:
            with z.open(entry) as part:
                shape, fortran, dtype = _npy_header(part)
            return Header(place, entry, shape, dtype.str, None)
        f.seek(info.header_offset + 26)
        lengths = np.frombuffer(f.read(4), "<u2")
        f.seek(info.header_offset + 30 + int(lengths.sum()))
        shape, fortran, dtype = _npy_header(f)
        return Header(place, entry, shape, dtype.str, None if fortran and len(shape) > 1 else f.tell())


def _nested(a: np.ndarray) -> pa.Array:
    """Rows of an array as lists of lists of numbers."""
    out = pa.array(a.reshape(-1).astype(float))
    for axis in range(a.ndim - 1, 0, -1):
        width = a.shape[axis]
        out = pa.ListArray.from_arrays(pa.array(np.arange(int(np.prod(a.shape[:axis])) + 1, dtype=np.int32) * width), out)
    return out


@dataclass
class Rows(InputPartition):
    header: Header
    lo: int
    hi: int
    first: int  # number of the row lo among those of all files


class ArrayReader(DataSourceReader):
    def __init__(self, options, sizes: bool):
        self.files = store.files(options["path"], ".npz")
        self.part_bytes, self.sizes = int(options.get("partBytes", store.PART_BYTES)), sizes

    def partitions(self):
        out, before = [], 0
        for h in map(header, self.files):
            n = h.shape[0]
            step = max(self.part_bytes // h.row_bytes, 1) if h.offset is not None and not self.sizes else max(n, 1)
            out += [Rows(h, lo, min(lo + step, n), before + lo) for lo in range(0, max(n, 1), step)]
            before += n
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        h = part.header
        if self.sizes:
            yield pa.RecordBatch.from_arrays([pa.array([h.place.path]), pa.array([h.shape[0]], pa.int64())], ["path", "n"])
            return
        for lo, rows in _blocks(h, part.lo, part.hi):
            index = part.first + (lo - part.lo) + np.arange(len(rows))
            yield pa.RecordBatch.from_arrays([pa.array(index), pa.array([h.place.path] * len(rows)), _nested(rows)], ["example_idx", "path", "value"])


def _blocks(h: Header, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows lo .. hi - 1, some megabytes at a time."""
    step, dtype = max(STEP_BYTES // h.row_bytes, 1), np.dtype(h.dtype)
    with store.reading(h.place) as f:
        if h.offset is not None:
            f.seek(h.offset + lo * h.row_bytes)
            for k in range(lo, hi, step):
                n = min(step, hi - k)
                yield k, np.frombuffer(f.read(n * h.row_bytes), dtype).reshape(n, *h.shape[1:])
            return
        with zipfile.ZipFile(f) as z, z.open(h.entry) as part:
            shape, fortran, dtype = _npy_header(part)
            if fortran and len(shape) > 1:  # stored column by column, so only the whole has rows
                yield 0, np.frombuffer(part.read(), dtype).reshape(shape[::-1]).T
                return
            for k in range(lo, hi, step):
                n = min(step, hi - k)
                yield k, np.frombuffer(part.read(n * h.row_bytes), dtype).reshape(n, *shape[1:])


@dataclass
class Written(WriterCommitMessage):
    root: str
    paths: list[str]


class ArrayWriter(DataSourceArrowWriter):
    """A file for each partition, or for each value of ``nameColumn``, by which rows must have been dealt out.  The array is
    the other column, whose rows must have one shape."""

    def __init__(self, options, schema: StructType):
        self.root, self.by = options["path"], options.get("nameColumn")
        values = [f.name for f in schema.fields if f.name != self.by]
        if len(values) != 1:
            raise ValueError(f"one array can be written, not {values}")
        self.value = values[0]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        rows: dict[str, list[np.ndarray]] = {}
        alone = f"part-{uuid.uuid4().hex}"
        for batch in batches:
            names = batch.column(batch.schema.get_field_index(self.by)).to_pylist() if self.by else [alone] * batch.num_rows
            for name, value in zip(names, batch.column(batch.schema.get_field_index(self.value)).to_pylist(), strict=True):
                rows.setdefault(str(name), []).append(np.asarray(value, float))
        done = Written(self.root, [])
        for name, values in rows.items():
            out, path = store.writing(self.root, f"{name}.npz")
            done.paths.append(path)
            with out:
                np.savez(out, np.stack(values))
        return done

    def abort(self, messages: list[Written | None]) -> None:
        for message in messages:
            for path in message.paths if message else ():
                store.remove(message.root, path)


class ArrayFiles(DataSource):
    """example_idx (through all files, by path), path and value: the rows of the arrays, as nested lists of doubles."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> StructType:
        found = store.files(self.options["path"], ".npz")
        kind = DoubleType()
        for _ in header(found[0]).shape[1:] if found else ():
            kind = ArrayType(kind)
        return StructType([StructField("example_idx", LongType()), StructField("path", StringType()), StructField("value", kind)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader(self.options, False)

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options, schema)


class ArraySizes(DataSource):
    """path and n, the number of rows, of each file; only headers are read."""

    @classmethod
    def name(cls) -> str:
        return "npz_sizes"

    def schema(self) -> str:
        return "path string, n long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrayReader(self.options, True)
