"""Cost-balanced packing of token sequences.

A piece of ``n`` tokens costs ``LINEAR * n + QUADRATIC * n * n`` (the layers' work and that of attention within the
piece).  A worker packs shard after shard of its input.  In a shard, whole capacities are cut off long documents first;
the rest of all documents are taken in descending length, and each goes to the sequence of lowest cost that has room for
it.  One that fits nowhere is cut to fill the roomiest sequence, and its rest is placed the same way.

A shard of T tokens gets T // capacity full sequences and, for what remains, sequences whose lengths are the binary digits
of the remainder.  As a sequence needs no padding at a power of two, nothing is padded.

Nothing is shuffled; memory is bounded by ``shard_tokens`` and one document; a lost task packs its input split again.

Defined results: a null text is empty, so its document is the end id alone; rows with a null or repeated id are packed
like any other, each on its own; of documents with one length the earlier row goes first, and of sequences with one cost the
one with the lowest number; an empty table gives no pieces.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm import core
from tessera.llm.pretokens import library_memo

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, cost double"
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
SHARD_TOKENS = 2_000_000


def cost(n: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> float:
    return linear * n + quadratic * n * n


def sequence_sizes(total: int, capacity: int) -> list[int]:
    """Full sequences, then the binary digits of what remains: their sum is ``total``."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(lengths: list[int], capacity: int = 4096, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[int], list[float]]:
    """Pieces (document, start, length, sequence, offset), the length of each sequence and its cost."""
    sizes = sequence_sizes(sum(lengths), capacity)
    used, spent = [0] * len(sizes), [0.0] * len(sizes)
    pieces: list[tuple[int, int, int, int, int]] = []

    def place(doc: int, start: int, n: int, seq: int) -> None:
        pieces.append((doc, start, n, seq, used[seq]))
        used[seq] += n
        spent[seq] += cost(n, linear, quadratic)

    full, rests = 0, []
    for doc, n in enumerate(lengths):
        whole = n // capacity
        for k in range(whole):
            place(doc, k * capacity, capacity, full)
            full += 1
        if n % capacity:
            rests.append((-(n % capacity), doc, whole * capacity))
    heapq.heapify(rests)  # descending length, then the order of the documents
    # Open sequences by cost.  One without room for the piece at hand has none for an earlier, longer one either, but may
    # have room for a later one, so those passed over come back when pieces have become short enough: they wait by room.
    by_cost = [(0.0, s) for s in range(full, len(sizes))]
    heapq.heapify(by_cost)
    waiting: list[tuple[int, int]] = []  # (-room, sequence)
    while rests:
        n, doc, start = heapq.heappop(rests)
        n = -n
        while waiting and -waiting[0][0] >= n:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(by_cost, (spent[s], s))
        while by_cost and sizes[by_cost[0][1]] - used[by_cost[0][1]] < n:
            s = heapq.heappop(by_cost)[1]
            heapq.heappush(waiting, (used[s] - sizes[s], s))
        if by_cost:
            s = heapq.heappop(by_cost)[1]
        else:
            s = heapq.heappop(waiting)[1]  # the roomiest: fill it, the rest of the piece goes on
            room = sizes[s] - used[s]
            heapq.heappush(rests, (room - n, doc, start + room))
            n = room
        place(doc, start, n, s)
        if used[s] < sizes[s]:
            heapq.heappush(by_cost, (spent[s], s))
    return pieces, sizes, spent


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece.  sequence_id is unique over the table; sequence_length and cost are those of its sequence."""
    core.small_batches(docs.sparkSession)

    def emit(ids: list, parts: list[np.ndarray], base: int):
        pieces, sizes, spent = pack([len(p) for p in parts], capacity)
        rows = [(ids[d], a, n, zlib.crc32(parts[d][a : a + n]), len(parts[d]), base + s, o, sizes[s], spent[s]) for d, a, n, s, o in pieces]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 8 + [pa.float64()]
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), kinds, strict=True)], names)

    def run(batches):
        memo = library_memo(path)
        ids: list = []
        parts: list[np.ndarray] = []
        total, base = 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_ids, texts in core.groups(batch):
                flat, at = memo.tokens(texts)
                for i, a, b in zip(doc_ids, at[:-1], at[1:], strict=True):
                    ids.append(i)
                    parts.append(np.append(flat[a:b], np.uint32(end_id)).astype("<u4"))
                    total += len(parts[-1])
                    if total >= shard_tokens:
                        yield from emit(ids, parts, base)
                        base += len(sequence_sizes(total, capacity))
                        ids, parts, total = [], [], 0
        if parts:
            yield from emit(ids, parts, base)

    return core.id_text(docs).mapInArrow(run, SCHEMA)
