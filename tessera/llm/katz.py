"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights, partitioned count tables.

Words are lower-cased (A-Z) and known by a 64-bit hash; every document ends with one end token and has one begin symbol
before its first token, so the n-gram of a document's j-th token has a context of j symbols at most.  For an n-gram of
``k`` symbols, context ``h`` and word ``w``, ``p(w | h)`` is ``d(c) * c(h, w) / c(h)`` if it was seen in training and else
``bow(h) * p(w | h')``, where ``h'`` is ``h`` without its first symbol: a recursion down to ``d(c) * c(w) / N``; what the
discounts leave there is the probability of an unknown word.  ``bow(h)`` is the left mass of ``h`` over the lower-order mass
of the words unseen after ``h``, so every context's distribution sums to one.  A context without training counts backs off
with weight one.

How it runs.  Documents are cut into blocks of at most ``BLOCK_TOKENS`` words; a block keeps its words as indices into its
own sorted vocabulary.  Each block sends its distinct n-grams of each order with their training counts to buckets, which are
equal ranges of the key space, so a word in every document is one entry per block and no key can make a bucket hot.  A bucket
adds up the counts, stores its part of the count table and answers each block with the totals of its keys.  N-grams found by
several blocks are given to one of them, which adds their mass to the sums for the backoff weight of their context.  Then,
order by order, as each order's sums need the weights of the order below: these sums and the requests for weights take a
round of the same kind, but for contexts that one block alone has, which stay where they are.  Only count-of-counts reach
the driver.

``score_documents`` trains and scores in one go; ``train`` leaves the tables at a path and ``score`` evaluates any documents
by them.  All intermediate tables lie in the shared folder and every step can be repeated from them; a block is a
deterministic function of its row.

Defined results: a null text is empty (the end token alone); a null id counts as the text "" for the split, so the
document is held out; repeated rows are documents of their own; with no training documents N is 0 and an unknown word has
probability one.
"""

from __future__ import annotations

import functools
import json
import logging
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import core
from tessera.llm.core import U64, mix

log = logging.getLogger(__name__)

BLOCK_TOKENS = 1_500_000
#: Keys that a bucket gets from all blocks together, about.
BUCKET_KEYS = 3_000_000
K, ORDER = 5, 2
#: What counts above K give up, so that a context seen with frequent words only keeps some mass for the others.
RARE = 1e-6
BEGIN, END = (int(x) for x in mix(np.array([1, 2], U64)))

BLOCKS = "block long, ids array<long>, lens binary, held binary, tokens binary, vocab binary"
PARTS = "kind string, level int, bucket int, block long, keys binary, a binary, b binary, r array<long>, n array<long>"
NAMES = [x.split()[0] for x in PARTS.split(", ")]
TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(TYPES)], NAMES)


def is_held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def blocks(docs: DataFrame) -> DataFrame:
    """Documents as blocks of word indices; one narrow pass."""
    core.small_batches(docs.sparkSession)

    def run(batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        hashes: list[np.ndarray] = []
        lens: list[int] = []
        total = 0

        def flush():
            nonlocal n, ids, hashes, lens, total
            vocab, tokens = np.unique(np.concatenate([*hashes, np.array([BEGIN, END], U64)]), return_inverse=True)
            held = np.array([is_held_out(i) for i in ids])
            row = [base + n], [ids], [core.pack_array(np.array(lens, "<u4"))], [held.tobytes()], [core.pack_array(tokens[:-2].astype("<u4"))], [core.pack_sorted(vocab)]
            kinds = pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary()
            n, ids, hashes, lens, total = n + 1, [], [], [], 0
            core.give_back()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for doc_ids, texts in core.groups(batch):
                h, at = core.word_hashes(texts)
                ids += doc_ids
                sizes = np.diff(at)
                lens += (sizes + 1).tolist()
                hashes.append(np.insert(h, at[1:], U64(END)))
                total += len(hashes[-1])
                if total >= BLOCK_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    return core.id_text(docs).mapInArrow(run, BLOCKS)


class Words:
    """A block as read.  For each order k: its distinct n-grams (``keys``), the place where each first ends, the n-gram that
    ends at each place of ``at`` (places whose document has k - 1 symbols before them), and the number of its context among
    the n-grams of the order below."""

    def __init__(self, lens: bytes, held: bytes, tokens: bytes, vocab: bytes, order: int):
        self.lens = core.unpack_array(lens, "<u4").astype(np.int64)
        self.held = np.frombuffer(held, bool)
        self.tokens = core.unpack_array(tokens, "<u4")
        self.vocab = core.unpack_sorted(vocab)
        self.begin = int(np.searchsorted(self.vocab, U64(BEGIN)))
        self.ends = np.cumsum(self.lens)
        self.train = np.repeat(~self.held, self.lens)
        inside = np.arange(len(self.tokens)) - np.repeat(self.ends - self.lens, self.lens)
        word = self.vocab[self.tokens]
        self.keys, self.first = [self.vocab], [np.zeros(0, np.int64)]
        self.at, self.gram, self.context = [np.arange(len(self.tokens))], [self.tokens], [np.zeros(0, np.int64)]
        below, number = word, self.tokens
        for k in range(2, order + 1):
            at = np.flatnonzero(inside >= k - 2)
            before, context = np.empty(len(at), U64), np.empty(len(at), np.int64)
            fresh = inside[at] == 0  # for pairs only: the context is the begin symbol
            before[fresh], context[fresh] = U64(BEGIN), self.begin
            before[~fresh], context[~fresh] = below[at[~fresh] - 1], number[at[~fresh] - 1]
            key = mix(before * U64(0x9E3779B97F4A7C15) ^ word[at])
            keys, first, gram = np.unique(key, return_index=True, return_inverse=True)
            self.keys.append(keys)
            self.first.append(first)
            self.at.append(at)
            self.gram.append(gram)
            self.context.append(context)
            below, number = np.zeros(len(word), U64), np.zeros(len(word), np.int64)
            below[at], number[at] = key, gram

    def counts(self, k: int) -> np.ndarray:
        """Training counts of the n-grams of order k (begin: as a context)."""
        out = np.bincount(self.gram[k - 1][self.train[self.at[k - 1]]], minlength=len(self.keys[k - 1]))
        if k == 1:
            out[self.begin] = int((~self.held).sum())
        return out

    def by_doc(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.add.reduceat(values, self.ends - self.lens)]) if len(values) else np.zeros(1)
        return sums[1:]


def _send(batches, k: int, buckets: int):
    for batch in batches:
        for block, lens, held, tokens, vocab in zip(*(batch.column(c).to_pylist() for c in ("block", "lens", "held", "tokens", "vocab")), strict=True):
            w = Words(lens, held, tokens, vocab, k)
            keys, counts = w.keys[k - 1], w.counts(k)
            cut = core.bucket_slices(keys, buckets)
            for b in range(buckets):
                s = slice(cut[b], cut[b + 1])
                if cut[b] < cut[b + 1]:
                    yield _rows([("ask", k, b, block, core.pack_sorted(keys[s]), core.pack_array(counts[s].astype("<u8")), None, None, None)])
            del w, keys, counts
            core.give_back()


def _count(table: pa.Table) -> pa.Table:
    """One bucket: adds up, stores its part of the count table, answers each block: totals, and for each key whether the block
    owns it and whether it alone has it."""
    level, bucket = table["level"][0].as_py(), table["bucket"][0].as_py()
    order = np.argsort(np.array(table["block"]))
    ask = [core.unpack_sorted(table["keys"][i].as_py()) for i in order]
    have = np.concatenate([core.unpack_array(table["a"][i].as_py(), "<u8") for i in order])
    keys, inverse = np.unique(np.concatenate(ask), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, inverse, have.astype(np.int64))
    alone = np.bincount(inverse, minlength=len(keys)) == 1
    giver = np.flatnonzero(have > 0)
    owner = np.zeros(len(inverse), bool)  # the first block, in ascending order, that counted the key in training
    owner[giver[np.unique(inverse[giver], return_index=True)[1]]] = True
    seen = total > 0
    real = total[seen & (keys != U64(BEGIN))] if level == 1 else total[seen]
    r, n = np.unique(real, return_counts=True)
    rows = [("model", level, bucket, None, core.pack_sorted(keys[seen]), core.pack_array(total[seen].astype("<u8")), None, r.tolist(), n.tolist())]
    at = 0
    for i, a in zip(order, ask, strict=True):
        s = slice(at, at + len(a))
        bits = np.packbits(np.concatenate([owner[s], alone[inverse[s]]])).tobytes()
        rows.append(("reply", level, bucket, table["block"][int(i)].as_py(), None, core.pack_array(total[inverse[s]].astype("<u8")), bits, None, None))
        at += len(a)
    return pa.Table.from_batches([_rows(rows)])


def katz_factors(n: list) -> np.ndarray | None:
    """d(1) .. d(K) by Katz's formula from n1 .. n(K + 1), or none if a number is zero or a factor outside 0 to 1."""
    if min(n) <= 0:
        return None
    c = np.arange(1, K + 1)
    cut = (K + 1) * n[K] / n[0]
    if cut >= 1:
        return None
    d = ((c + 1) * np.array(n[1:]) / np.array(n[:K]) / c - cut) / (1 - cut)
    return d if ((d > 0) & (d < 1)).all() else None


def smoothed(table: dict[int, int]) -> list[float]:
    """n1 .. n(K + 1) on the line of Simple Good-Turing (Gale & Sampson 1995): log of n_r, averaged over the gap between its
    neighbours, by log r, fitted over all r."""
    r = np.array(sorted(table), float)
    n = np.array([table[int(x)] for x in r], float)
    before, after = np.append(0, r[:-1]), np.append(r[1:], 2 * r[-1] - (r[-2] if len(r) > 1 else 0))
    slope, start = np.polyfit(np.log(r), np.log(2 * n / (after - before)), 1)
    return np.exp(start + slope * np.log(np.arange(1, K + 2))).tolist()


def discounts(n: list[int], table: dict[int, int] | None = None) -> np.ndarray:
    """d(0), d(1) .. d(K), d(more), from the numbers of types seen 1 .. K + 1 times and, in ``table``, any number of times.

    Good-Turing's, from the numbers as they are if Katz's formula can use them and else from their smoothed line.  Only a
    degenerate table, with a zero among the numbers or no more types seen once than twice, so that there is no falling line,
    gets one absolute discount instead, n1 / (n1 + 2 n2) or a half.
    """
    c = np.arange(1, K + 1)
    out = np.full(K + 2, 1 - RARE)
    out[0] = 0
    rule, d = "Good-Turing", katz_factors(n[: K + 1])
    if d is None and table and min(n[: K + 1]) > 0 and n[0] > n[1]:
        rule, d = "smoothed Good-Turing", katz_factors(smoothed(table))
    if d is None:
        absolute = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        rule, d = "absolute", (c - absolute) / c
    log.log(logging.WARNING if rule == "absolute" else logging.INFO, "%s discounts from n1 .. n%d = %s", rule, K + 1, n[: K + 1])
    out[1 : K + 1] = d
    return out


class Model:
    """The numbers that all blocks share, from the numbers of n-grams of each order that were seen each number of times."""

    def __init__(self, seen: list[dict[int, int]]):
        one = seen[0]
        self.total, self.types = sum(r * n for r, n in one.items()), sum(one.values())
        rare = [one.get(r, 0) for r in range(1, K + 2)]
        self.d = [discounts([table.get(r, 0) for r in range(1, K + 2)], table) for table in seen]
        left = sum(n * c * (1 - d) for n, c, d in zip(rare[:K], range(1, K + 1), self.d[0][1:], strict=False))
        left += RARE * (self.total - sum(n * c for n, c in zip(rare[:K], range(1, K + 1), strict=False)))
        self.unknown = left / self.total if self.total else 1.0

    @property
    def order(self) -> int:
        return len(self.d)

    def factor(self, k: int, c: np.ndarray) -> np.ndarray:
        return self.d[k - 1][np.minimum(c, K + 1)]

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.factor(1, c) * c / max(self.total, 1), self.unknown)


def _in_order(part: pa.Table, column: str, kind: str) -> list[np.ndarray]:
    """A column of the answers to one block in the order of its keys."""
    order = np.argsort(np.array(part["bucket"]))
    return [core.unpack_array(part[column][int(i)].as_py(), kind) for i in order]


class Answers:
    """Totals, ownership and loneliness of a block's n-grams by order, and the weights that it asked for."""

    def __init__(self, reply: pa.Table):
        self.totals: dict[int, np.ndarray] = {}
        self.owned: dict[int, np.ndarray] = {}
        self.alone: dict[int, np.ndarray] = {}
        self.weights: dict[int, np.ndarray] = {}
        levels, kinds = np.array(reply["level"]), np.array(reply["kind"])
        for k in np.unique(levels).tolist():
            part = reply.filter(pa.array((levels == k) & (kinds == "reply")))
            totals = _in_order(part, "a", "<u8")
            order = np.argsort(np.array(part["bucket"]))
            bits = [np.unpackbits(np.frombuffer(part["b"][int(i)].as_py(), np.uint8), count=2 * len(t)).astype(bool).reshape(2, -1) for i, t in zip(order, totals, strict=True)]
            if bits:
                self.totals[k] = np.concatenate(totals).astype(np.int64)
                self.owned[k], self.alone[k] = np.concatenate(bits, axis=1)
            part = reply.filter(pa.array((levels == k) & (kinds == "weight")))
            self.weights[k] = np.concatenate([np.zeros(0), *_in_order(part, "a", "<f8")])


class Evaluation:
    """Probabilities of a block's tokens, order by order, and what the weights of the next order need."""

    def __init__(self, model: Model, words: Words, answers: Answers):
        self.model, self.words, self.answers = model, words, answers
        self.p = model.unigram(answers.totals[1])[words.tokens]

    def sums(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the contexts of order k: left mass, lower-order mass, whether there is any, and whether its weight is wanted
        here."""
        w, totals, n = self.words, self.answers.totals, len(self.words.keys[k - 2])
        mine = self.answers.owned[k]
        at = w.first[k - 1][mine]
        c, context = totals[k][mine], w.context[k - 1][at]
        left = np.bincount(context, (1 - self.model.factor(k, c)) * c, n) / np.maximum(totals[k - 1], 1)
        lower = np.bincount(context, self.p[w.at[k - 1][at]], n)
        want = np.zeros(n, bool)
        want[w.context[k - 1][self.lacking(k)]] = True
        return left, lower, np.bincount(context, minlength=n) > 0, want

    def lacking(self, k: int) -> np.ndarray:
        """Places (among those of order k) that back off from a context seen in training."""
        w, totals = self.words, self.answers.totals
        return np.flatnonzero((totals[k][w.gram[k - 1]] == 0) & (totals[k - 1][w.context[k - 1]] > 0))

    def sent(self, k: int, has: np.ndarray, want: np.ndarray) -> np.ndarray:
        """Numbers of the contexts whose sums travel: those that other blocks have too."""
        return np.flatnonzero((has | want) & ~self.answers.alone[k - 1])

    def weights(self, k: int, left: np.ndarray, lower: np.ndarray, has: np.ndarray, want: np.ndarray) -> np.ndarray:
        """Weight of each context of order k; one where it isn't known here yet."""
        out = np.where(self.answers.alone[k - 1] & has, _weight(left, lower), 1.0)
        sent = self.sent(k, has, want)
        if len(self.answers.weights.get(k, ())):
            out[sent[want[sent]]] = self.answers.weights[k]
        return out

    def seen(self, k: int) -> np.ndarray:
        """Probability of the tokens whose n-gram of order k was seen, by its count; of others, that of the order below."""
        w, totals = self.words, self.answers.totals
        c = totals[k][w.gram[k - 1]]
        direct = self.model.factor(k, c) * c / np.maximum(totals[k - 1][w.context[k - 1]], 1)
        out = self.p.copy()
        out[w.at[k - 1]] = np.where(c > 0, direct, self.p[w.at[k - 1]])
        return out

    def climb(self, k: int) -> None:
        """From probabilities of order k - 1 to those of order k."""
        weights = self.weights(k, *self.sums(k))
        lacking = self.lacking(k)
        self.p = self.seen(k)
        self.p[self.words.at[k - 1][lacking]] *= weights[self.words.context[k - 1][lacking]]


def _weight(left: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return np.where(left > 0, left / np.maximum(1 - lower, 1e-300), 1.0)


DOCS = "kind string, bucket int, block long, keys binary, left_mass binary, lower_mass binary, wanted binary, ids array<long>, held binary, n_tokens binary, n_known binary, base binary, score binary, missing binary"
DOC_NAMES = [x.split()[0] for x in DOCS.split(", ")]
DOC_TYPES = [pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.int64()), *[pa.binary()] * 6]


def _score(model: Model, buckets: int, k: int, block: pa.Table, reply: pa.Table) -> pa.Table:
    """One block at order k: its share of the sums for the weights and the ones it wants; weights that need no other block;
    and, at the last order, the scores but for the weights that are not here yet."""
    row = {c: block[c][0].as_py() for c in block.column_names}
    w = Words(row["lens"], row["held"], row["tokens"], row["vocab"], k)
    e = Evaluation(model, w, Answers(reply))
    for lower_order in range(2, k):
        e.climb(lower_order)
    left, lower, has, want = e.sums(k)
    sent, rows = e.sent(k, has, want), []
    keys = w.keys[k - 2][sent]
    cut = core.bucket_slices(keys, buckets)
    for b in range(buckets):
        s = slice(cut[b], cut[b + 1])
        if cut[b] < cut[b + 1]:
            at = sent[s]
            rows.append(("sums", b, row["block"], core.pack_sorted(keys[s]), core.pack_array(left[at]), core.pack_array(lower[at]), np.packbits(want[at]).tobytes(), *[None] * 7))
    own = np.flatnonzero(has & e.answers.alone[k - 1])
    rows.append(("own", None, row["block"], core.pack_sorted(w.keys[k - 2][own]), core.pack_array(_weight(left[own], lower[own])), *[None] * 9))
    if k == model.order:
        c1 = e.answers.totals[1]
        base = np.log10((c1 + 0.1) / (model.total + 0.1 * (model.types + 1)))
        known = w.by_doc((c1[w.tokens] > 0).astype(float)).astype("<u4")
        weights, lacking = e.weights(k, left, lower, has, want), e.lacking(k)
        p = e.seen(k)
        context = w.context[k - 1][lacking]
        p[w.at[k - 1][lacking]] *= weights[context]
        # Documents, contexts (as ranks among those asked for) and how often, of tokens that need a weight from elsewhere.
        doc, asked = np.repeat(np.arange(len(w.lens)), w.lens)[w.at[k - 1][lacking]], np.zeros(len(want), bool)
        asked[sent] = want[sent]
        away = asked[context]
        pairs, n = np.unique(doc[away] * np.int64(len(want)) + (np.cumsum(asked) - 1)[context[away]], return_counts=True)
        missing = np.stack([pairs // len(want), pairs % len(want), n]).astype("<u4")
        rows.append(("docs", None, row["block"], *[None] * 4, row["ids"], row["held"], w.lens.astype("<u4").tobytes(), known.tobytes(), w.by_doc(base[w.tokens]).tobytes(), w.by_doc(np.log10(p)).tobytes(), core.pack_array(missing.reshape(-1))))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(DOC_TYPES)], DOC_NAMES)


WEIGHTS = "kind string, bucket int, block long, keys binary, weights binary"


def _weigh(table: pa.Table) -> pa.Table:
    """One bucket: backoff weights of its contexts, and the answers to the blocks that want some."""
    bucket = table["bucket"][0].as_py()
    order = np.argsort(np.array(table["block"]))
    ask = [core.unpack_sorted(table["keys"][int(i)].as_py()) for i in order]
    keys, inverse = np.unique(np.concatenate(ask), return_inverse=True)
    left, lower = (np.bincount(inverse, np.concatenate([core.unpack_array(table[c][int(i)].as_py(), "<f8") for i in order]), len(keys)) for c in ("left_mass", "lower_mass"))
    weight = _weight(left, lower)
    rows, at = [("model", bucket, None, core.pack_sorted(keys), core.pack_array(weight))], 0
    for i, a in zip(order, ask, strict=True):
        want = np.unpackbits(np.frombuffer(table["wanted"][int(i)].as_py(), np.uint8), count=len(a)).astype(bool)
        if want.any():
            rows.append(("reply", bucket, table["block"][int(i)].as_py(), None, core.pack_array(weight[inverse[at : at + len(a)][want]])))
        at += len(a)
    kinds = pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in WEIGHTS.split(", ")])


def _finish(total: int, docs: pa.Table, reply: pa.Table) -> pa.Table:
    row = {c: docs[c][0].as_py() for c in docs.column_names}
    score = np.frombuffer(row["score"], "<f8").copy()
    doc, ctx, n = core.unpack_array(row["missing"], "<u4").reshape(3, -1)
    if len(doc):
        order = np.argsort(np.array(reply["bucket"]))
        weights = np.concatenate([core.unpack_array(reply["weights"][int(i)].as_py(), "<f8") for i in order])
        score += np.bincount(doc, n * np.log10(weights[ctx]), len(score))
    held = np.frombuffer(row["held"], bool)
    known, n_tokens = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("n_known", "n_tokens"))
    return _scores(row["ids"], held, n_tokens, known, total, np.frombuffer(row["base"], "<f8"), score)


def _scores(ids: list, held: np.ndarray, n_tokens: np.ndarray, known: np.ndarray, total: int, base: np.ndarray, score: np.ndarray) -> pa.Table:
    return pa.table(
        [pa.array(ids, pa.int64()), pa.array(held), pa.array(n_tokens), pa.array(known), pa.array(np.full(len(held), total)), pa.array(base), pa.array(score)],
        [x.split()[0] for x in SCHEMA.split(", ")],
    )


def _scorer(model: Model, buckets: int, k: int):
    def run(block: pa.Table, reply: pa.Table) -> pa.Table:
        out = _score(model, buckets, k, block, reply)
        core.give_back()
        return out

    return run


def _light(kernel):
    """A kernel of one table that leaves no freed memory behind."""

    def run(table: pa.Table) -> pa.Table:
        out = kernel(table)
        core.give_back()
        return out

    return run


def _every(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def _fit(docs: DataFrame, order: int, path: str) -> tuple[DataFrame, Model]:
    """Trains on the documents that are not held out.  At ``path``: the model (see ``train``), and what scoring the documents
    themselves needs.  Returns their scores."""
    if order < 2:
        raise ValueError("the model backs off, so its order is two or more")
    spark = docs.sparkSession
    n = core.tasks(spark)
    with core.bucketed(blocks(docs), "block", "lm_blocks") as table:
        size = table.count()
        buckets = max(n, -(-size * BLOCK_TOKENS // BUCKET_KEYS))
        for k in range(1, order + 1):
            asked = table.select("block", "lens", "held", "tokens", "vocab").mapInArrow(lambda it, k=k: _send(it, k, buckets), PARTS)
            with core.tidy(spark):
                asked.groupBy("bucket").applyInArrow(_light(_count), PARTS).write.partitionBy("kind").parquet(f"{path}/counts/order={k}")
        counts = _every([spark.read.schema(PARTS).parquet(f"{path}/counts/order={k}") for k in range(1, order + 1)])
        seen = counts.where("kind = 'model'").select("level", F.explode(F.arrays_zip("r", "n")).alias("_c"))
        sums = seen.groupBy("level", "_c.r").agg(F.sum("_c.n").alias("n")).collect()  # distinct counts: fewer than sqrt(2 N) an order
        tables = [{int(x["r"]): int(x["n"]) for x in sums if x["level"] == k} for k in range(1, order + 1)]
        model = Model(tables)
        replies = counts.where("kind = 'reply'").select("block", "kind", "level", "bucket", "a", "b")
        for k in range(2, order + 1):
            mine, here = replies.where(F.col("level") <= k), f"{path}/sums/order={k}"
            for j in range(2, k):
                known = spark.read.schema(WEIGHTS).parquet(f"{path}/weights/order={j}").where("kind = 'reply'")
                mine = mine.unionByName(known.select("block", F.lit("weight").alias("kind"), F.lit(j).alias("level"), "bucket", F.col("weights").alias("a"), F.lit(None).cast("binary").alias("b")))
            joined = table.groupBy("block").cogroup(mine.groupBy("block"))
            with core.tidy(spark):
                joined.applyInArrow(_scorer(model, buckets, k), DOCS).write.partitionBy("kind").parquet(here)
            parts = spark.read.schema(DOCS).parquet(here)
            own = parts.where("kind = 'own'").select(F.lit("own").alias("kind"), "bucket", "block", "keys", F.col("left_mass").alias("weights"))
            weighed = parts.where("kind = 'sums'").select("bucket", "block", "keys", "left_mass", "lower_mass", "wanted").groupBy("bucket").applyInArrow(_light(_weigh), WEIGHTS)
            with core.tidy(spark):
                weighed.unionByName(own).write.partitionBy("kind").parquet(f"{path}/weights/order={k}")
            for kind in ("sums", "own"):
                core.drop(spark, f"{here}/kind={kind}")
    for k in range(1, order + 1):
        core.drop(spark, f"{path}/counts/order={k}/kind=reply")
    about = spark.createDataFrame([(json.dumps({"order": order, "buckets": buckets, "seen": [sorted(t.items()) for t in tables]}),)], "about string")
    about.coalesce(1).write.parquet(f"{path}/about")
    scored = spark.read.schema(DOCS).parquet(f"{path}/sums/order={order}").where("kind = 'docs'")
    answers = spark.read.schema(WEIGHTS).parquet(f"{path}/weights/order={order}").where("kind = 'reply'").select("block", "bucket", "weights")
    docs_only = scored.select("block", "ids", "held", "n_tokens", "n_known", "base", "score", "missing")
    return docs_only.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda left, right: _finish(model.total, left, right), SCHEMA), model


def score_documents(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Trains on the documents that are not held out and scores all of them."""
    return _fit(docs, order, core.shared_dir(docs.sparkSession, "lm"))[0]


def train(docs: DataFrame, path: str, order: int = ORDER) -> None:
    """Leaves a model at ``path``: ``counts/order=k/kind=model`` and ``weights/order=k`` hold the n-grams of order k and the
    weights of their contexts by ranges of keys; ``about`` has the numbers that all share."""
    spark = docs.sparkSession
    _fit(docs, order, path)
    core.drop(spark, f"{path}/sums")
    for k in range(2, order + 1):
        core.drop(spark, f"{path}/weights/order={k}/kind=reply")


def _deal_own(batches, buckets: int):
    """Weights that single blocks worked out, by the buckets of their keys."""
    for batch in batches:
        for keys, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            k, w = core.unpack_sorted(keys), core.unpack_array(weights, "<f8")
            cut = core.bucket_slices(k, buckets)
            rows = [(b, core.pack_sorted(k[cut[b] : cut[b + 1]]), core.pack_array(w[cut[b] : cut[b + 1]])) for b in range(buckets) if cut[b] < cut[b + 1]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "keys", "a"])


def _look_up(asked: pa.Table, stored: pa.Table) -> pa.Table:
    """One bucket of one order: counts, and weights as contexts, of the keys that blocks ask for."""
    if not len(asked):
        return pa.Table.from_batches([_rows([])])
    found = {}
    for kind, dtype in (("count", "<u8"), ("weight", "<f8")):
        part = stored.filter(pa.array(np.array(stored["kind"]) == kind)) if len(stored) else stored
        keys = np.concatenate([np.zeros(0, U64), *(core.unpack_sorted(x) for x in part["keys"].to_pylist())])
        values = np.concatenate([np.zeros(0, dtype), *(core.unpack_array(x, dtype) for x in part["a"].to_pylist())])
        by = np.argsort(keys)
        found[kind] = keys[by], values[by]
    rows = []
    for level, bucket, block, blob in zip(*(asked[c].to_pylist() for c in ("level", "bucket", "block", "keys")), strict=True):
        wanted, out = core.unpack_sorted(blob), []
        for kind, none in (("count", 0), ("weight", 1.0)):
            keys, values = found[kind]
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            out.append(np.where(keys[at] == wanted, values[at], none) if len(keys) else np.full(len(wanted), none))
        rows.append(("reply", level, bucket, block, None, core.pack_array(out[0].astype("<u8")), core.pack_array(out[1].astype("<f8")), None, None))
    return pa.Table.from_batches([_rows(rows)])


def _evaluate(model: Model, block: pa.Table, reply: pa.Table) -> pa.Table:
    """Scores of a block by counts and weights that are all there: the recursion, token by token, from the lowest order up."""
    row = {c: block[c][0].as_py() for c in block.column_names}
    w = Words(row["lens"], row["held"], row["tokens"], row["vocab"], model.order)
    levels = np.array(reply["level"])
    part = {k: reply.filter(pa.array(levels == k)) for k in range(1, model.order + 1)}
    totals = {k: np.concatenate(_in_order(t, "a", "<u8")).astype(np.int64) for k, t in part.items()}
    p = model.unigram(totals[1])[w.tokens]
    for k in range(2, model.order + 1):
        weights = np.concatenate(_in_order(part[k - 1], "b", "<f8"))
        c, context = totals[k][w.gram[k - 1]], totals[k - 1][w.context[k - 1]]
        backed = p[w.at[k - 1]] * np.where(context > 0, weights[w.context[k - 1]], 1.0)
        p[w.at[k - 1]] = np.where(c > 0, model.factor(k, c) * c / np.maximum(context, 1), backed)
    base = np.log10((totals[1] + 0.1) / (model.total + 0.1 * (model.types + 1)))
    known = w.by_doc((totals[1][w.tokens] > 0).astype(float)).astype(np.int64)
    return _scores(row["ids"], w.held, w.lens, known, model.total, w.by_doc(base[w.tokens]), w.by_doc(np.log10(p)))


def score(docs: DataFrame, path: str) -> DataFrame:
    """Scores of any documents by the model at ``path``; none of them is learned from."""
    spark = docs.sparkSession
    about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
    model, buckets = Model([{int(r): int(n) for r, n in t} for t in about["seen"]]), about["buckets"]
    table = core.materialise(blocks(docs), "lm-scored")
    columns = ["block", "lens", "held", "tokens", "vocab"]
    asked, stored = [], []
    for k in range(1, model.order + 1):
        asked.append(table.select(*columns).mapInArrow(lambda it, k=k: _send(it, k, buckets), PARTS).select("level", "bucket", "block", "keys"))
        held = spark.read.schema(PARTS).parquet(f"{path}/counts/order={k}").where("kind = 'model'").select(F.lit("count").alias("kind"), F.lit(k).alias("level"), "bucket", "keys", "a")
        stored.append(held)
        if k < model.order:
            weights = spark.read.schema(WEIGHTS).parquet(f"{path}/weights/order={k + 1}")
            shared = weights.where("kind = 'model'").select("bucket", "keys", F.col("weights").alias("a"))
            own = weights.where("kind = 'own'").select("keys", "weights").mapInArrow(lambda it: _deal_own(it, buckets), "bucket int, keys binary, a binary")
            stored.append(shared.unionByName(own).select(F.lit("weight").alias("kind"), F.lit(k).alias("level"), "bucket", "keys", "a"))
    replies = _every(asked).groupBy("level", "bucket").cogroup(_every(stored).groupBy("level", "bucket")).applyInArrow(_look_up, PARTS)
    return table.groupBy("block").cogroup(replies.select("block", "level", "bucket", "a", "b").groupBy("block")).applyInArrow(lambda a, b: _evaluate(model, a, b), SCHEMA)
