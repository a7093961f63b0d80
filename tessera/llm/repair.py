"""Token ids on disk under a Re-Pair grammar, with random access.

Per block of ids, frequent pairs of neighbours are replaced by new symbols, again and again: a round counts all pairs,
makes a rule of each pair seen ``LEAST`` times or more, and replaces occurrences that do not overlap, more frequent pairs
first.  Rounds end when no pair is frequent.

A block holds, in fixed-width arrays: its documents, the rules, the expansion length of each rule, the sequence, and the
position in the expanded ids of every ``STEP``-th symbol.  A range of ids is decoded from the symbols that cover it.

The blocks of a shard (a range of ascending document ids, one task) are rows of a Parquet table in the shared folder: the
writers of Spark commit them whole, so a lost executor's shard is written again, and any file system of Spark's will do.

Defined results: a null text is empty (the end id alone); documents with a null id come first; rows with the same id are
ordered by their text; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import core
from tessera.llm.pretokens import library_memo

BLOCK_IDS = 1 << 19
LEAST, STEP = 5, 64
#: Distinct pre-tokens that a worker remembers here, some 70 MB.
MEMO_ROWS = 1_000_000
MAGIC = b"RPB1"
BLOCKS = "shard int, block int, before long, n_ids long, payload binary"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _number(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """1, 2 .. for each distinct key that occurs ``least`` times or more, 0 for others; and the counts, that of 0 as 0."""
    slot = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).view(np.int64)
    at = np.flatnonzero(np.bincount(slot, minlength=1 << 18)[slot] >= least)  # a frequent key is in a frequent slot
    codes, found = pd.factorize(keys[at])
    counts = np.bincount(codes, minlength=len(found))
    often = counts >= least
    out = np.zeros(len(keys), np.int64)
    out[at] = np.where(often, np.cumsum(often), 0)[codes]
    return out, np.concatenate([[0], counts[often]])


def grammar(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, rules as pairs, first new symbol).  A rule's symbols are ids or earlier rules.

    Every pair left occurs fewer than ``least`` times (overlaps in a run of one symbol not counted), for any ``least`` of two
    or more: in each round the most frequent pair wins all its places, so a round that makes no rule is the last.  A round
    touches the places of frequent pairs and their neighbours only; symbols are linked, so nothing is moved.
    """
    least = max(least, 2)
    n = len(ids)
    symbol = ids.astype(np.int64)
    first = int(symbol.max()) + 1 if n else 0
    if n < 2:
        return symbol.astype(np.uint32), np.zeros((0, 2), np.uint32), first
    # The place after the last is a sentinel, before the first as after the last.
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[n] = before[0] = n
    symbol = np.append(symbol, -1)
    # The number of the pair that starts at a place; 0 for a rare one, as pairs never become more frequent.
    pair = np.zeros(n + 1, np.int64)
    pair[: n - 1], counts = _number(symbol[: n - 1] << 32 | symbol[1:n], least)
    alive, marked, score = np.ones(n + 1, bool), np.zeros(n + 1, bool), np.full(n + 1, -1)
    rules: list[np.ndarray] = []
    made = first
    places = np.flatnonzero(pair)
    while len(places):
        doubled = places[symbol[places] == symbol[after[places]]]
        odd = doubled[:0]
        if len(doubled):  # every other place of a run of one symbol
            starts = np.ones(len(doubled), bool)
            starts[1:] = after[doubled[:-1]] != doubled[1:]
            run = np.maximum.accumulate(np.where(starts, np.arange(len(doubled)), 0))
            odd = doubled[(np.arange(len(doubled)) - run) & 1 == 1]
        free = counts - np.bincount(pair[odd], minlength=len(counts)) if len(odd) else counts
        score[places] = free[pair[places]] << 32 | len(counts) - pair[places]  # the earlier pair of equally frequent ones
        score[odd] = -1
        mine = score[places]
        taken = places[(mine > score[before[places]]) & (mine > score[after[places]]) & (free[pair[places]] >= least)]
        score[places] = -1
        used = np.bincount(pair[taken], minlength=len(counts))
        good = used >= least
        taken = taken[good[pair[taken]]]
        if not len(taken):
            break
        number = (np.cumsum(good) - 1)[pair[taken]]
        example = np.empty(int(good.sum()), np.int64)
        example[number] = taken
        rules.append(np.stack([symbol[example], symbol[after[example]]], 1))
        gone = after[taken]
        symbol[taken] = made + number
        made += len(example)
        follow = after[gone]
        marked[taken] = marked[gone] = marked[before[taken]] = True
        touched = np.flatnonzero(marked)
        marked[touched] = False
        counts -= np.bincount(pair[touched], minlength=len(counts))
        after[taken], before[follow] = follow, taken
        after[n] = n
        alive[gone] = False
        pair[touched] = 0
        # What is touched and stays starts a pair with a new symbol, or the last place, which starts none.
        fresh = touched[alive[touched] & (after[touched] < n)]
        numbers, new = _number(symbol[fresh] << 32 | symbol[after[fresh]], least)
        pair[fresh] = np.where(numbers > 0, numbers + len(counts) - 1, 0)
        counts[0] = 0
        counts = np.concatenate([counts, new[1:]])
        fresh = fresh[numbers > 0]
        places = places[alive[places] & (counts[pair[places]] >= least)]
        marked[places] = marked[fresh] = True
        places = np.flatnonzero(marked)
        marked[places] = False
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2))
    return symbol[:n][alive[:n]].astype(np.uint32), pairs.astype(np.uint32), first


def expand(seq: np.ndarray, rules: np.ndarray, first: int, lengths: np.ndarray | None = None) -> np.ndarray:
    """Ids of a sequence.  Expansion lengths give every symbol its place at once, so only symbols that are still rules are
    handled again."""
    if not len(rules):
        return seq.astype(np.uint32)
    widths = np.concatenate([np.ones(first, np.int64), rule_lengths(rules, first) if lengths is None else lengths])
    symbols = seq.astype(np.int64)
    ends = np.cumsum(widths[symbols])
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    places = ends - widths[symbols]
    while len(symbols):
        new = symbols >= first
        plain = ~new
        out[places[plain]] = symbols[plain]
        pairs, places = rules[symbols[new] - first].astype(np.int64), places[new]
        symbols, places = pairs.T.reshape(-1), np.concatenate([places, places + widths[pairs[:, 0]]])
    return out


def rule_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule expands to."""
    out = np.zeros(len(rules), np.uint32)
    todo = np.arange(len(rules))
    while len(todo):
        part = [np.where(rules[todo, k] < first, 1, out[np.where(rules[todo, k] < first, 0, rules[todo, k] - np.uint32(first))]) for k in (0, 1)]
        ready = (part[0] > 0) & (part[1] > 0)
        out[todo[ready]] = (part[0] + part[1])[ready]
        todo = todo[~ready]
    return out


def _narrow(a: np.ndarray) -> tuple[bytes, bytes]:
    """The low 16 bits and the next 8 of each symbol, in fixed width."""
    return a.astype("<u2").tobytes(), (a >> 16).astype(np.uint8).tobytes()


def write_block(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    seq, rules, first = grammar(ids)
    if first + len(rules) > 1 << 24:
        raise ValueError("ids of 2**24 and more don't fit the block format")
    lengths = rule_lengths(rules, first)
    width = np.where(seq < first, 1, lengths[np.where(seq < first, 0, seq - first)] if len(rules) else 1)
    marks = np.concatenate([[0], np.cumsum(width)])[:-1][::STEP].astype("<u4") if len(seq) else np.zeros(0, "<u4")
    null = np.array([i is None for i in doc_ids], np.uint8)
    parts = [
        np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes(), null.tobytes(), counts.astype("<u4").tobytes(),
        *_narrow(rules.reshape(-1)), lengths.astype("<u4").tobytes(), *_narrow(seq), marks.tobytes(),
    ]
    return MAGIC + struct.pack("<5Q", len(doc_ids), len(ids), len(rules), len(seq), first) + b"".join(parts)


class Block:
    """A block as read: arrays over its bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        n_docs, self.n_ids, n_rules, n_seq, self.first = struct.unpack_from("<5Q", data, 4)
        at = 44

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        self.counts = take("<u4", n_docs)
        low, high = take("<u2", 2 * n_rules), take("u1", 2 * n_rules)
        self.rules = (low.astype(np.uint32) | high.astype(np.uint32) << 16).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        self.low, self.high = take("<u2", n_seq), take("u1", n_seq)
        self.marks = take("<u4", -(-n_seq // STEP))

    def symbols(self, lo: int, hi: int) -> np.ndarray:
        return self.low[lo:hi].astype(np.uint32) | self.high[lo:hi].astype(np.uint32) << 16

    def ids(self) -> np.ndarray:
        return expand(self.symbols(0, len(self.low)), self.rules, self.first, self.lengths)

    def _width(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that each symbol stands for."""
        rule = symbols >= self.first
        return np.where(rule, self.lengths[np.where(rule, symbols - np.uint32(self.first), 0)], 1) if len(self.rules) else np.ones(len(symbols), np.int64)

    def _cut(self, symbol: int, start: int, stop: int) -> list[int]:
        """Symbols for the ids [start, stop) of one symbol: lengths say which children of a rule are needed whole, in part or
        not at all, so nothing outside the range is expanded."""
        out, stack = [], [(symbol, start, stop)]
        while stack:
            s, a, b = stack.pop()
            width = int(self.lengths[s - self.first]) if s >= self.first else 1
            a, b = max(a, 0), min(b, width)
            if a >= b:
                continue
            if b - a == width:
                out.append(s)
                continue
            left, right = (int(x) for x in self.rules[s - self.first])
            half = int(self.lengths[left - self.first]) if left >= self.first else 1
            stack += [(right, a - half, b - half), (left, a, b)]
        return out

    def decode(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop): the marks lead to the run of symbols, the lengths to the symbols and the children in it."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.marks, start, "right")) - 1
        b = int(np.searchsorted(self.marks, stop, "left"))
        symbols = self.symbols(a * STEP, min(b * STEP, len(self.low)))
        ends = int(self.marks[a]) + np.cumsum(self._width(symbols), dtype=np.int64)
        lo, hi = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        begins = lambda k: int(ends[k - 1]) if k else int(self.marks[a])
        if lo == hi:
            middle = self._cut(int(symbols[lo]), start - begins(lo), stop - begins(lo))
        else:
            middle = [*self._cut(int(symbols[lo]), start - begins(lo), 1 << 40), *symbols[lo + 1 : hi].tolist(), *self._cut(int(symbols[hi]), 0, stop - begins(hi))]
        return expand(np.array(middle, np.uint32), self.rules, self.first, self.lengths)


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, partitions: int | None = None) -> None:
    """Writes the ids of all documents in ascending doc_id order as blocks at ``path``."""
    spark = docs.sparkSession
    core.small_batches(spark)

    def run(batches):
        memo, shard = library_memo(tokenizer, MEMO_ROWS), TaskContext.get().partitionId()
        ids: list = []
        parts: list[np.ndarray] = []
        held = before = block = 0

        def flush():
            nonlocal held, before, block, ids, parts
            counts = np.array([len(p) for p in parts])
            payload = write_block(ids, counts, np.concatenate(parts))
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())], [x.split()[0] for x in BLOCKS.split(", ")])
            before, block, held, ids, parts = before + held, block + 1, 0, [], []
            return out

        for batch in batches:
            for doc_ids, texts in core.groups(batch):
                flat, at = memo.tokens(texts)
                for i, a, b in zip(doc_ids, at[:-1], at[1:], strict=True):
                    ids.append(i)
                    parts.append(np.append(flat[a:b], np.uint32(end_id)))
                    held += len(parts[-1])
                    if held >= BLOCK_IDS:
                        yield flush()
        if parts:
            yield flush()

    # A text's beginning follows its order, so the rows of one id, or of none, are spread as well.
    order = ("doc_id", F.substring("text", 1, 32))
    rows = core.id_text(docs).repartitionByRange(partitions or core.tasks(spark), *order).sortWithinPartitions("doc_id", "text")
    with core.tidy(spark):
        rows.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)


def shard_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Ids before each shard.  One number per shard, that is per writing task, reaches the driver."""
    out, total = {}, 0
    for shard, n in sorted(spark.read.schema(BLOCKS).parquet(path).groupBy("shard").agg(F.sum("n_ids")).collect()):
        out[shard] = total
        total += n
    return out


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and checksum of each document, from the blocks."""
    starts = shard_starts(spark, path)

    def run(batches):
        for batch in batches:
            for shard, before, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = Block(payload)
                ids = block.ids().astype("<u4")
                ends = np.cumsum(block.counts, dtype=np.int64)
                lo = ends - block.counts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(lo.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids, pa.int64()), pa.array(starts[shard] + before + lo), pa.array(block.counts, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.schema(BLOCKS).parquet(path).select("shard", "before", "payload").mapInArrow(run, SCHEMA)
