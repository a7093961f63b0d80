"""Motif files (.cb) as a source: filters on names reach the parser, filters on files' names the list of files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from tessera.sources import store

#: Files that a partition reads.
FILES = 256


def sections(text: str) -> list[tuple[str, np.ndarray]]:
    """(name, counts) of each motif of a file, with a row for each position."""
    lines = text.splitlines()
    if not lines or not lines[0].startswith(">"):
        raise ValueError("a motif file starts with '>'")
    found: list[tuple[str, list]] = []
    for line in lines:
        if line.startswith(">"):
            found.append((line.strip().replace(">", ""), []))
        elif line.strip():
            found[-1][1].append([float(x) for x in line.split()])
    out = []
    for name, rows in found:
        m = np.array(rows, float)
        if m.ndim != 2 or m.shape[1] != 4:
            raise ValueError(f"motif {name} does not have four columns")
        out.append((name, m))
    return out


def probabilities(counts: np.ndarray) -> list[list[float]]:
    """(4, L): each position divided by its sum; a zero sum gives NaN."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return (counts / counts.sum(1, keepdims=True)).T.tolist()


@dataclass
class Files(InputPartition):
    places: list[store.Place]


class MotifReader(DataSourceReader):
    def __init__(self, options):
        self.places, self.per_part = store.files(options["path"], ".cb"), int(options.get("filesPerPartition", FILES))
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in (("motif_name",), ("cluster_name",)):
                wanted = set(f.value if isinstance(f, In) else [f.value])
                if f.attribute == ("motif_name",):
                    self.names = wanted if self.names is None else self.names & wanted
                else:
                    self.places = [p for p in self.places if p.name.removesuffix(".cb") in wanted]
            else:
                yield f

    def partitions(self):
        return [Files(self.places[k : k + self.per_part]) for k in range(0, len(self.places), self.per_part)] or [Files([])]

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        rows = []
        for place in part.places:
            with store.reading(place) as f:
                content = f.read()
            try:
                found = sections(content.decode())
            except (ValueError, IndexError):
                continue  # a malformed file is skipped whole
            rows += [(n, place.name.removesuffix(".cb"), probabilities(m), place.path, i) for i, (n, m) in enumerate(found) if self.names is None or n in self.names]
        kinds = [pa.string(), pa.string(), pa.list_(pa.list_(pa.float64())), pa.string(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["motif_name", "cluster_name", "ppm", "path", "at"])


class MotifFiles(DataSource):
    """motif_name, cluster_name (the file's), ppm, path, and at, the motif's place in its file."""

    @classmethod
    def name(cls) -> str:
        return "motif_files"

    def schema(self) -> str:
        return "motif_name string, cluster_name string, ppm array<array<double>>, path string, at int"

    def reader(self, schema: StructType) -> DataSourceReader:
        return MotifReader(self.options)
