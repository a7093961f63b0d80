"""Benchmark decontamination by a generalised suffix automaton of the test items.

Words are runs of digits, letters and code points from U+0080 on, in lower case (A-Z).  A window is ``window`` consecutive
words of an item; an item with fewer words is one window.  A document's word is hit if it lies in an occurrence of a window.

The items are dealt to parts of about ``PART_WORDS`` words (a longer item in pieces that overlap by a window, so none is lost),
and a task builds the automaton of each part: states with their longest length, suffix link and transitions, the items whose
windows end in a state, and the short items that end there.  A document's words stream through it; the state and the
length of the longest match at each word tell which windows end there.  Words that no item has, and pairs of neighbours that no
item has, end every match, so the stream begins anew behind them: only the stretches between them, if long enough for a
window, are walked word by word, and nothing is lost.

Documents stay where they are.  The automata are broadcast if they have ``MOST_BYTES`` at most; larger collections of items are
met in several passes, each with as many parts as that allows, and the documents' hits so far go along as a column.

Defined results: a null text has no words, nor has an empty one; items without words are never met; rows of the benchmark that
share an id are one item with windows of each; an item without an id hits words, but is neither counted nor listed; repeated
documents, and those without an id, are judged each on its own; an empty table of documents gives an empty result, and an empty
benchmark hits nothing; other columns play no part in ``rate`` and pass through ``clean``.  Two words are the same if their
64-bit hashes are.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tessera.llm import core
from tessera.llm.core import U64

WINDOW = 10
PIECE_WORDS, PART_WORDS, MOST_BYTES = 20_000, 400_000, 64 << 20


def word_places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and length (in code points of its text) of each word of all texts, and offsets (n + 1) of the texts in them."""
    cps, offsets = core.code_points(texts)
    low = core.lower_ascii(cps)
    solid = (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    starts, lengths, doc = core.words(low, offsets, solid)
    return core.hash_slices(low, starts, lengths), starts - offsets[doc], lengths, np.searchsorted(doc, np.arange(len(texts) + 1))


# ---------------------------------------------------------------- automaton

class Automaton:
    """A generalised suffix automaton over sequences of numbers, with the items that windows belong to.

    ``next[s * size + w]`` is the state after word w.  ``ends[s]``: the items with a window that is the ``window`` words long
    string of state s; ``short[s]``: (length, item) of the items shorter than that whose words are a string of s; ``hook[s]``:
    the nearest state on the suffix links of s that has short items, or 0.
    """

    def __init__(self, pieces: list[tuple[str | None, np.ndarray]], window: int):
        self.window = window
        self.vocabulary, flat = np.unique(np.concatenate([np.zeros(0, U64), *(h for _, h in pieces)]), return_inverse=True)
        self.size = max(len(self.vocabulary), 1)
        bounds = np.cumsum([0, *(len(h) for _, h in pieces)])
        sequences = [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        pairs = [np.zeros(0, np.int64)]
        pairs += [flat[a : b - 1].astype(np.int64) * self.size + flat[a + 1 : b] for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a > 1]
        self.pairs = np.unique(np.concatenate(pairs))
        self.length, self.link = [0], [-1]
        self._out: list[dict[int, int]] = [{}]
        for words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._mark([item for item, _ in pieces], sequences)
        self.least = min([window, *(m for marks in self.short.values() for m, _ in marks)]) if pieces else window
        self.next = {s * self.size + w: t for s, out in enumerate(self._out) for w, t in out.items()}
        del self._out

    def _state(self, length: int, out: dict[int, int], link: int) -> int:
        self.length.append(length)
        self._out.append(out)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for the strings of q that end an extension of p: q itself, or a copy of it with their length."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self._out[q]), self.link[q])
        while p >= 0 and self._out[p].get(w) == q:
            self._out[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self._out[last].get(w)
        if q is not None:
            return self._split(last, w, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self._out[p]:
            self._out[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self._out[p][w])
        return new

    def _mark(self, items: list, sequences: list[list[int]]) -> None:
        # From short to long, so that a state's suffixes are known before it.
        self.at = np.full(len(self.length), -1)  # the state on the links that holds the string of ``window`` words
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for s in order:
            if self.length[s] >= self.window:
                up = self.link[s]
                self.at[s] = self.at[up] if self.length[up] >= self.window else s
        self.at = self.at.tolist()
        ends: dict[int, set] = {}
        short: dict[int, set] = {}
        for item, words in zip(items, sequences, strict=True):
            s = 0
            for i, w in enumerate(words):
                s = self._out[s][w]
                if i + 1 >= self.window:
                    ends.setdefault(self.at[s], set()).add(item)
            if 0 < len(words) < self.window:
                short.setdefault(s, set()).add((len(words), item))
        self.ends = {s: tuple(x) for s, x in ends.items()}
        self.short = {s: tuple(x) for s, x in short.items()}
        self.hook = [0] * len(self.length)
        for s in order:
            up = self.link[s]
            self.hook[s] = up if up in self.short else self.hook[up] if up > 0 else 0

    def stretches(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of hashes, and the stretches [a, b) of a text in which every word and every pair of neighbours is some
        item's, if long enough for a window.  ``at``: offsets of the texts in ``h``."""
        if not len(self.vocabulary) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        number = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[number] == h
        join = known[1:] & known[:-1]
        join[at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(h))] - 1] = False  # no pair crosses into the next text
        here = np.flatnonzero(join)
        if len(here) and len(self.pairs):
            pair = number[here].astype(np.int64) * self.size + number[here + 1]
            place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            join[here] = self.pairs[place] == pair
        elif len(here):
            join[here] = False
        begins = known & ~np.concatenate([[False], join])
        stops = known & ~np.concatenate([join, [False]])
        a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        long = b - a >= self.least
        return number, a[long], b[long]

    def walk(self, words: list[int]) -> tuple[list[tuple[int, int]], set]:
        """(first, end) of the windows that occur in ``words``, and their items."""
        state = length = 0
        spans, items = [], set()
        for i, w in enumerate(words):
            to = self.next.get(state * self.size + w)
            while to is None and state:
                state = self.link[state]
                length = self.length[state]
                to = self.next.get(state * self.size + w)
            if to is None:
                continue
            state, length = to, length + 1
            if length >= self.window:
                spans.append((i + 1 - self.window, i + 1))
                items.update(self.ends.get(self.at[state], ()))
            s = state if state in self.short else self.hook[state]
            while s:
                for m, item in self.short[s]:
                    if m <= length:
                        spans.append((i + 1 - m, i + 1))
                        items.add(item)
                s = self.hook[s]
        return spans, items


def _pieces(window: int, piece: int):
    def run(batches):
        for batch in batches:
            for ids, texts in core.groups(batch):
                h, _, _, at = word_places(texts)
                rows = []
                for item, a, b in zip(ids, at[:-1].tolist(), at[1:].tolist(), strict=True):
                    for lo in range(a, max(b - window + 1, a + 1), piece) if b > a else ():
                        rows.append((item, h[lo : min(lo + piece + window - 1, b)].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["item", "words"])

    return run


def _build(window: int, table: pa.Table) -> pa.Table:
    pieces = [(item, np.frombuffer(words, "<u8").astype(U64)) for item, words in zip(table["item"].to_pylist(), table["words"].to_pylist(), strict=True)]
    blob = zstandard.ZstdCompressor(level=3).compress(pickle.dumps(Automaton(pieces, window), protocol=5))
    return pa.table([pa.array([table["part"][0].as_py()], pa.int32()), pa.array([blob], pa.binary())], ["part", "automaton"])


def automata(items: DataFrame, window: int = WINDOW, piece: int = PIECE_WORDS, part: int = PART_WORDS) -> tuple[DataFrame, str]:
    """(part, automaton) for ``items`` (item_id, text), and the table's path."""
    core.small_batches(items.sparkSession)
    rows = items.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pieces, at = core.stored(rows.mapInArrow(_pieces(window, piece), "item string, words binary"), "benchmark-pieces")
    words = (pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // 8
    parts = max(1, -(-words // part))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(parts)).cast("int"))
    made = core.stored(dealt.groupBy("part").applyInArrow(lambda t: _build(window, t), "part int, automaton binary"), "benchmark-automata")
    core.drop(items.sparkSession, at)
    return made


# ---------------------------------------------------------------- documents

SPAN = StructType([StructField("first", LongType()), StructField("end", LongType())])
HITS = StructType([StructField("_n_words", LongType()), StructField("_n_hit", LongType()), StructField("_spans", ArrayType(SPAN)), StructField("_items", ArrayType(StringType()))])

_READY: dict = {}


def _load(shared: Broadcast) -> list[Automaton]:
    """The automata of a pass; a worker keeps those of the last pass it has seen."""
    if _READY.get("of") != shared._path:
        _READY.clear()
        unzip = zstandard.ZstdDecompressor()
        _READY.update(of=shared._path, automata=[pickle.loads(unzip.decompress(b)) for b in shared.value])
    return _READY["automata"]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _scan(texts: list[str], before: list[list | None], held: list[list | None], found: list[Automaton]) -> list[tuple]:
    """(n_words, n_hit, spans, items) of each text: spans in code points, merged where words follow each other, with those
    that earlier passes found."""
    h, starts, lengths, at = word_places(texts)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items = [set(x or ()) for x in held]
    for k, earlier in enumerate(before):
        own = starts[at[k] : at[k + 1]]
        spans[k] += [(int(np.searchsorted(own, s["first"])), int(np.searchsorted(own, s["end"]))) for s in earlier or ()]
    for automaton in found:
        number, begins, stops = automaton.stretches(h, at)
        for a, b, k in zip(begins.tolist(), stops.tolist(), (np.searchsorted(at, begins, "right") - 1).tolist(), strict=True):
            more, named = automaton.walk(number[a:b].tolist())
            low = a - int(at[k])
            spans[k] += _merge([(low + x, low + y) for x, y in more])
            items[k] |= named
    out = []
    for k, own in enumerate(spans):
        merged, base = _merge(own), int(at[k])
        places = [{"first": int(starts[base + x]), "end": int(starts[base + y - 1] + lengths[base + y - 1])} for x, y in merged]
        out.append((int(at[k + 1]) - base, sum(y - x for x, y in merged), places, sorted(x for x in items[k] if x is not None)))
    return out


def _pass(docs: DataFrame, blobs: list[bytes]) -> DataFrame:
    """``docs`` with the columns of HITS, for the items of ``blobs`` and what those columns held before."""
    spark = docs.sparkSession
    core.small_batches(spark)
    shared = spark.sparkContext.broadcast(blobs)
    keys = [c for c in docs.columns if c not in HITS.fieldNames()]
    at, again = [c.lower() for c in keys].index("text"), len(keys) < len(docs.columns)
    whole = docs.select(*map(core.column, keys), *(HITS.fieldNames() if again else []))
    schema = StructType([*whole.select(*map(core.column, keys)).schema.fields, *HITS.fields])
    numbered = whole.toDF(*(f"c{i}" for i in range(len(whole.columns))))  # mapInArrow can't pass names with dots

    def run(batches):
        found = _load(shared)
        for batch in batches:
            n, texts = batch.num_rows, batch.column(at).cast(pa.string()).fill_null("")
            before = batch.column(len(keys) + 2).to_pylist() if again else [None] * n
            held = batch.column(len(keys) + 3).to_pylist() if again else [None] * n
            hits: list[tuple] = []
            for _, part in core.groups(pa.RecordBatch.from_arrays([pa.nulls(n), texts], ["key", "text"])):
                lo = len(hits)
                hits += _scan(part, before[lo : lo + len(part)], held[lo : lo + len(part)], found)
            columns = [pa.array([x[0] for x in hits], pa.int64()), pa.array([x[1] for x in hits], pa.int64())]
            columns += [pa.array([x[2] for x in hits], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array([x[3] for x in hits], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], [f"c{i}" for i in range(len(keys) + 4)])

    out = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    return numbered.mapInArrow(run, out).toDF(*schema.fieldNames())


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, most: int = MOST_BYTES, **sizes: int) -> DataFrame:
    """``docs`` (with a column text) and _n_words, _n_hit, _spans (of hit words that follow each other: first and end, in code
    points) and _items (the ids, as ascending texts, of the items that occur)."""
    made, path = automata(items, window, **sizes)
    weights = made.select("part", F.octet_length("automaton").alias("bytes")).orderBy("part").collect()  # a row per part
    passes: list[list[int]] = [[]]
    room = most
    for part, size in weights:
        if passes[-1] and size > room:
            passes.append([])
            room = most
        passes[-1].append(part)
        room -= size
    for k, parts in enumerate(passes):
        blobs = [bytes(r[0]) for r in made.where(F.col("part").isin(parts)).select("automaton").collect()]
        docs = _pass(docs, blobs)
        if k + 1 < len(passes):
            docs = core.materialise(docs, "benchmark-pass")
    core.drop(docs.sparkSession, path)
    return docs


def rate(docs: DataFrame, items: DataFrame, window: int = WINDOW, **sizes: int) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row."""
    found = find(core.id_text(docs), items, window, **sizes)
    listed = F.sha2(F.array_join("_items", ","), 256)
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, longest: int = 0, coverage: float = 0.5, **sizes: int) -> DataFrame:
    """``docs`` without what the items have: a document goes if more than ``coverage`` of its words are hit; in the others each
    span of hit words that follow each other, with more than ``longest`` words, is cut from the text.

    The limit of a span counts its words as a text of its own, which is what they are."""
    found = find(docs, items, window, **sizes).where(F.col("_n_hit") <= F.col("_n_words") * coverage)
    text, spans = F.col("text"), F.col("_spans")
    words = lambda s: F.regexp_count(F.substring(text, (s["first"] + 1).cast("int"), (s["end"] - s["first"]).cast("int")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    cut = F.filter(spans, lambda s: words(s) > longest) if longest else spans
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    piece = lambda acc, s: F.concat(acc["kept"], F.substring(text, (acc["at"] + 1).cast("int"), (s["first"] - acc["at"]).cast("int")))
    left = F.aggregate(cut, start, lambda acc, s: F.struct(piece(acc, s).alias("kept"), s["end"].alias("at")), lambda acc: F.concat(acc["kept"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit((1 << 31) - 1))))
    return found.select(*(F.when(F.size(cut) > 0, left).otherwise(text).alias(c) if c.lower() == "text" else core.column(c) for c in docs.columns))
