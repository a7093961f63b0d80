"""Signal files in the bigWig format (Kent et al. 2010, Bioinformatics 26:2204) as a source and a sink.

The header leads to a tree of chromosome names and to an index of data blocks by their spans.  Both are read when partitions are
planned; a partition is a run of blocks, and filters on the chromosome and on the span leave out blocks that the index rules
out.  Blocks of all three kinds (bed graph, variable step, fixed step), compressed or not, in either byte order are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tessera.sources import store
from tessera.sources.array_files import Written

#: Fixed values of the format.
MAGIC, TREE_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
BED_GRAPH, VARIABLE_STEP, FIXED_STEP = 1, 2, 3
#: Items of a data block and children of a node, as written here; blocks that a partition reads.
ITEMS, CHILDREN, BLOCKS = 1024, 256, 512
SIGNAL = "chrom string, start long, stop long, value double"


@dataclass
class Layout:
    """What a file's header says: byte order, places of its parts, and the size of an inflated block (0: not compressed)."""

    order: str
    tree: int
    index: int
    inflated: int


def layout(f) -> Layout:
    f.seek(0)
    head = f.read(64)
    order = next((o for o in "<>" if struct.unpack(o + "I", head[:4])[0] == MAGIC), None)
    if order is None:
        raise ValueError("not a bigWig file")
    _, _, tree, _, index, _, _, _, _, inflated, _ = struct.unpack(order + "HHQQQHHQQIQ", head[4:])
    return Layout(order, tree, index, inflated)


def chromosomes(f, at: Layout) -> dict[int, tuple[str, int]]:
    """(name, size) by number."""
    f.seek(at.tree)
    magic, _, key, _, _, _ = struct.unpack(at.order + "IIIIQQ", f.read(32))
    if magic != TREE_MAGIC:
        raise ValueError("no tree of chromosomes")
    out, todo = {}, [f.tell()]
    while todo:
        f.seek(todo.pop())
        leaf, _, n = struct.unpack(at.order + "BBH", f.read(4))
        for _ in range(n):
            name = f.read(key).rstrip(b"\0").decode()
            if leaf:
                number, size = struct.unpack(at.order + "II", f.read(8))
                out[number] = name, size
            else:
                todo.append(struct.unpack(at.order + "Q", f.read(8))[0])
    return out


def blocks(f, at: Layout, wanted: set[int] | None = None, low: int = 0, high: int = 1 << 62) -> list[tuple[int, int]]:
    """(offset, size) of the data blocks that may hold intervals of these chromosomes that begin before ``high`` and end
    after ``low``; branches of the index that can't are not read."""
    f.seek(at.index)
    if struct.unpack(at.order + "I", f.read(4))[0] != INDEX_MAGIC:
        raise ValueError("no index of data blocks")
    out, todo = [], [at.index + 48]
    while todo:
        f.seek(todo.pop())
        leaf, _, n = struct.unpack(at.order + "BBH", f.read(4))
        width = 32 if leaf else 24
        raw = f.read(n * width)
        for k in range(n):
            c1, s1, c2, s2, offset = struct.unpack_from(at.order + "IIIIQ", raw, k * width)
            if wanted is not None and not any(c1 <= c <= c2 for c in wanted):
                continue
            if c1 == c2 and (s1 >= high or s2 <= low):
                continue
            if leaf:
                out.append((offset, struct.unpack_from(at.order + "Q", raw, k * width + 24)[0]))
            else:
                todo.append(offset)
    return sorted(out)


def intervals(raw: bytes, at: Layout) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Chromosome, starts, stops and values of a data block."""
    if at.inflated:
        raw = zlib.decompress(raw)
    chrom, first, _, step, span, kind, _, n = struct.unpack(at.order + "IIIIIBBH", raw[:24])
    o = at.order
    if kind == BED_GRAPH:
        rows = np.frombuffer(raw, [("s", o + "u4"), ("e", o + "u4"), ("v", o + "f4")], n, 24)
        return chrom, rows["s"].astype(np.int64), rows["e"].astype(np.int64), rows["v"].astype(float)
    if kind == VARIABLE_STEP:
        rows = np.frombuffer(raw, [("s", o + "u4"), ("v", o + "f4")], n, 24)
        starts, values = rows["s"].astype(np.int64), rows["v"].astype(float)
    elif kind == FIXED_STEP:
        starts, values = first + step * np.arange(n, dtype=np.int64), np.frombuffer(raw, o + "f4", n, 24).astype(float)
    else:
        raise ValueError(f"no kind {kind} of data blocks")
    return chrom, starts, starts + span, values


@dataclass
class Run(InputPartition):
    place: store.Place
    at: Layout
    names: dict[int, str]
    blocks: list[tuple[int, int]]


class SignalReader(DataSourceReader):
    def __init__(self, options):
        self.places, self.per_part = store.files(options["path"], ".bw"), int(options.get("blocksPerPartition", BLOCKS))
        self.chroms: set[str] | None = None
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("chrom",):
                wanted = set(f.value if isinstance(f, In) else [f.value])
                self.chroms = wanted if self.chroms is None else self.chroms & wanted
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("start",):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("stop",):
                self.low = max(self.low, f.value - isinstance(f, GreaterThanOrEqual))
            yield f  # blocks hold neighbours too, so rows are filtered again

    def partitions(self):
        out = []
        for place in self.places:
            with store.reading(place) as f:
                at = layout(f)
                names = {k: name for k, (name, _) in chromosomes(f, at).items()}
                wanted = None if self.chroms is None else {k for k, name in names.items() if name in self.chroms}
                found = blocks(f, at, wanted, self.low, self.high)
            out += [Run(place, at, names, found[k : k + self.per_part]) for k in range(0, len(found), self.per_part)]
        return out or [Run(store.Place("", "", 0), Layout("<", 0, 0, 0), {}, [])]

    def read(self, part: Run) -> Iterator[pa.RecordBatch]:
        if not part.blocks:
            return
        with store.reading(part.place) as f:
            for offset, size in part.blocks:
                f.seek(offset)
                chrom, starts, stops, values = intervals(f.read(size), part.at)
                yield pa.RecordBatch.from_arrays([pa.array([part.names[chrom]] * len(starts)), pa.array(starts), pa.array(stops), pa.array(values)], ["chrom", "start", "stop", "value"])


# ---------------------------------------------------------------- writing

def _tree(names: list[tuple[bytes, int]], begin: int) -> bytes:
    """The tree of chromosome names, from ``begin`` on: leaves of ``CHILDREN`` names, under as many levels as needed."""
    key = max((len(n) for n, _ in names), default=1)
    head = struct.pack("<IIIIQQ", TREE_MAGIC, CHILDREN, key, 8, len(names), 0)
    level = [(n, struct.pack("<II", i, size)) for i, (n, size) in enumerate(names)]
    return head + _levels(level, begin + len(head), key, lambda n, value: n.ljust(key, b"\0") + value, lambda n, at: n.ljust(key, b"\0") + struct.pack("<Q", at), lambda group: group[0][0])


def _levels(items: list, begin: int, _: int, leaf, branch, cover) -> bytes:
    """Nodes of a tree over ``items`` (key, value), the root first, as bytes that begin at ``begin``."""
    levels = [[items[k : k + CHILDREN] for k in range(0, max(len(items), 1), CHILDREN)]]
    while len(levels[-1]) > 1:
        above = [(cover(g), None) for g in levels[-1]]
        levels.append([above[k : k + CHILDREN] for k in range(0, len(above), CHILDREN)])
    levels.reverse()
    sizes = [[4 + sum(len(leaf(*i) if depth == len(levels) - 1 else branch(i[0], 0)) for i in node) for node in level] for depth, level in enumerate(levels)]
    starts, at = [], begin
    for level in sizes:
        starts.append([at + sum(level[:k]) for k in range(len(level))])
        at += sum(level)
    out = b""
    for depth, level in enumerate(levels):
        last, child = depth == len(levels) - 1, 0
        for node in level:
            out += struct.pack("<BBH", last, 0, len(node))
            for key, value in node:
                out += leaf(key, value) if last else branch(key, starts[depth + 1][child])
                child += 1
    return out


def encode(rows: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]], kind: int = BED_GRAPH, items: int = ITEMS, compress: bool = True) -> bytes:
    """A file of the intervals of each chromosome (name, ascending starts, stops, values), in order of names."""
    rows = sorted(rows, key=lambda r: r[0].encode())
    names = [(name.encode(), int(stops.max()) if len(stops) else 0) for name, _, stops, _ in rows]
    tree = _tree(names, 64)
    at = 64 + len(tree)
    data, index, inflated = struct.pack("<Q", sum(-(-len(r[1]) // items) for r in rows)), [], 0
    for number, (_, starts, stops, values) in enumerate(rows):
        for k in range(0, len(starts), items):
            s, e, v = starts[k : k + items], stops[k : k + items], values[k : k + items]
            step = int(s[1] - s[0]) if len(s) > 1 else 1
            span = int(e[0] - s[0])
            if kind != BED_GRAPH and ((e - s) != span).any() or kind == FIXED_STEP and (np.diff(s) != step).any():
                raise ValueError("intervals of unlike widths or steps need a bed graph")
            body = {
                BED_GRAPH: lambda: np.rec.fromarrays([s.astype("<u4"), e.astype("<u4"), v.astype("<f4")]).tobytes(),
                VARIABLE_STEP: lambda: np.rec.fromarrays([s.astype("<u4"), v.astype("<f4")]).tobytes(),
                FIXED_STEP: lambda: v.astype("<f4").tobytes(),
            }[kind]()
            raw = struct.pack("<IIIIIBBH", number, int(s[0]), int(e.max()), step if kind == FIXED_STEP else 0, span if kind != BED_GRAPH else 0, kind, 0, len(s)) + body
            inflated = max(inflated, len(raw))
            raw = zlib.compress(raw) if compress else raw
            index.append(((number, int(s[0]), number, int(e.max())), struct.pack("<QQ", at + len(data), len(raw))))
            data += raw
    begin = at + len(data)
    whole = lambda group: (*min(i[0][:2] for i in group), *max(i[0][2:] for i in group))
    span = whole(index) if index else (0, 0, 0, 0)
    head = struct.pack("<IIQIIIIQII", INDEX_MAGIC, CHILDREN, len(index), *span, begin, 1, 0)
    nodes = _levels(index, begin + 48, 0, lambda key, value: struct.pack("<IIII", *key) + value, lambda key, to: struct.pack("<IIIIQ", *key, to), whole)
    top = struct.pack("<IHHQQQHHQQIQ", MAGIC, 4, 0, 64, at, begin, 0, 0, 0, 0, inflated if compress else 0, 0)
    return top + tree + data + head + nodes


class SignalWriter(DataSourceArrowWriter):
    """A file for each partition, of the chromosomes in it; rows must have been dealt by chromosome.  The format's index stands
    behind the data, so a task holds its file until it is whole."""

    def __init__(self, options):
        self.root, self.kind = options["path"], {"bedGraph": BED_GRAPH, "variableStep": VARIABLE_STEP, "fixedStep": FIXED_STEP}[options.get("blocks", "bedGraph")]
        self.items = int(options.get("itemsPerBlock", ITEMS))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        table = pa.Table.from_batches(list(batches), pa.schema([("chrom", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.float64())]))
        done = Written(self.root, [])
        if not len(table):
            return done
        table = table.sort_by([("chrom", "ascending"), ("start", "ascending")])
        names = table["chrom"].to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
        starts, stops, values = (table[c].to_numpy() for c in ("start", "stop", "value"))
        rows = [(str(names[a]), starts[a:b], stops[a:b], values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        out, path = store.writing(self.root, f"part-{uuid.uuid4().hex}.bw")
        done.paths.append(path)
        with out:
            out.write(encode(rows, self.kind, self.items))
        return done

    def abort(self, messages: list[Written | None]) -> None:
        for message in messages:
            for path in message.paths if message else ():
                store.remove(message.root, path)


class BigWig(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SIGNAL

    def reader(self, schema: StructType) -> DataSourceReader:
        return SignalReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> SignalWriter:
        return SignalWriter(self.options)
