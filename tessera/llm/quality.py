"""Quality rules: hashed n-gram log-likelihood ratio between trusted text and the raw corpus.

Words and pairs of neighbouring words are hashed to ``BUCKETS`` buckets.  Two multinomials over the buckets are counted
over all documents: that of the trusted ones and that of the whole corpus.  A document's score is the mean over its
n-grams of ``log p_trusted - log p_raw``, so long and short documents compare.  A document stays if its score is at least a
threshold.  Counts are whole numbers and a score adds its document's terms in their order, so a verdict
doesn't depend on how rows are dealt; nothing is sampled, and equal texts have equal verdicts.

The trusted counts are smoothed by as many counts as ``PRIOR`` times their sum, dealt as the raw corpus, so a bucket that
the trusted sample says nothing about is no worse than ``log(PRIOR / (1 + PRIOR))`` at any size of the sample.  The documents
are read three times (the trusted texts, which become a table, counts, verdicts); besides the trusted texts and their scores
only the bucket counts (a fixed number) move.

The threshold comes from the trusted texts themselves, at any number of them.  They are dealt to ``FOLDS`` folds by a hash of
the text, so copies stay together; each is scored by a fit without its fold, and of those that pass the base rules the score of
rank ``floor(QUANTILE * n)``, counted from the lowest, is the threshold.  So about one good document in a hundred is lost,
whatever the size of the table.  It is one number for all documents, and exact: nothing is sampled.

Base rules come first: fewer than 50 words, or more than half of the words inside repeated three-word windows.

Defined results: a null or empty text has no words, so it fails the base rules and is not kept; without trusted documents
all ratios are one and the base rules decide, as they do if no trusted document passes them; labels of unknown documents have no effect, repeated labels count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import core
from tessera.llm.core import U64
from tessera.llm.ranks import ranked

BUCKETS, PRIOR, FOLDS, QUANTILE = 10_000, 0.5, 5, 0.01
#: Slots of the bitmap for each trusted id, the most it may have (32 MB), and those of a segment (fixed by bitmap_construct_agg).
SLOTS, MOST_SLOTS, SEGMENT = 16, 1 << 28, 32_768
SYMBOLS = "#*$%&|<>"
BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
SCHEMA = BASE + ", score double, kept boolean"


def buckets_of(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs of all texts, and offsets (n + 1) of the texts in them."""
    h, at = core.word_hashes(texts)
    pairs = core.window_hashes(h, 2)
    n = np.diff(at)
    out = np.empty(int((2 * n - (n > 0)).sum()), np.int64)
    ends = np.concatenate([[0], np.cumsum(2 * n - (n > 0))])
    single = core.spread(ends[:-1], n)
    out[single] = (h % U64(buckets)).astype(np.int64)
    double = core.spread(ends[:-1] + n, np.maximum(n - 1, 0))
    inside = np.ones(len(h), bool)
    inside[at[1:][n > 0] - 1] = False  # the last word of a text starts no pair
    out[double] = (pairs % U64(buckets)).astype(np.int64)[inside[: len(pairs)]] if len(pairs) else 0
    return out, ends


def count_buckets(texts: DataFrame, buckets: int = BUCKETS, folds: int = 1) -> np.ndarray:
    """Counts of n-grams by fold and bucket.  ``texts`` has fold, if there are several, and text.

    Each task sends at most ``folds * buckets`` rows; the sums, as many rows, reach the driver.
    """

    def run(batches):
        counts = np.zeros((folds, buckets), np.int64)
        for batch in batches:
            for fold, part in _texts(batch):
                found, at = buckets_of(part, buckets)
                place = np.repeat(np.array(fold, np.int64), np.diff(at)) if folds > 1 else 0
                counts += np.bincount(place * buckets + found, minlength=folds * buckets).reshape(folds, buckets)
        b = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(counts.reshape(-1)[b])], ["bucket", "n"])

    out = np.zeros(folds * buckets, np.int64)
    for b, n in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[b] = n
    return out.reshape(folds, buckets)


def _texts(batch: pa.RecordBatch):
    """The texts of a batch, its last column, in bounded groups, and the first column beside them."""
    column = batch.column(batch.num_columns - 1)
    yield from core.groups(pa.RecordBatch.from_arrays([batch.column(0), column], ["key", "text"]))


def trusted_texts(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """The texts of the trusted documents, as a table in the shared folder.

    A bitmap sized by the number of trusted ids keeps most others out of the exchange; the join then decides.  It is a
    shuffled one at every size: the trusted ids grow with the corpus.  Beyond ``MOST_SLOTS / SLOTS`` ids the bitmap lets more
    rows through, and beyond ``MOST_SLOTS`` ids it is left out.
    """
    known = trusted.where("doc_id IS NOT NULL")
    n = known.count()
    near = rows.select("doc_id", "text")
    if n <= MOST_SLOTS:
        slots = min(max(1 << (SLOTS * n).bit_length(), SEGMENT), MOST_SLOTS)
        slot = lambda ids: F.pmod(F.xxhash64(ids), F.lit(slots))
        parts = known.select(slot(F.col("doc_id")).alias("slot")).groupBy(F.expr(f"slot DIV {SEGMENT}").alias("segment")).agg(F.expr(f"bitmap_construct_agg(slot % {SEGMENT})").alias("bits")).collect()
        bits = np.zeros(slots >> 3, np.uint8)
        for segment, part in parts:
            bits[segment * SEGMENT >> 3 : (segment + 1) * SEGMENT >> 3] = np.frombuffer(part, np.uint8)
        packed = rows.sparkSession.sparkContext.broadcast(bits.tobytes())

        def run(batches):
            filled = np.frombuffer(packed.value, np.uint8)
            for batch in batches:
                at = np.asarray(batch.column(0))
                yield batch.filter(pa.array((filled[at >> 3] >> (at & 7)).astype(np.uint8) & 1 == 1)).select(["doc_id", "text"])

        near = rows.select(slot(F.col("doc_id")).alias("slot"), "doc_id", "text").mapInArrow(run, "doc_id long, text string")
    return core.materialise(near.join(trusted.hint("shuffle_hash"), "doc_id", "left_semi").select("text"), "quality-trusted")


def log_ratios(raw: np.ndarray, good: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    p_raw = (raw + 1) / (raw.sum() + len(raw))
    m = max(prior * good.sum(), 1.0)
    return np.log((good + m * p_raw) / (good.sum() + m)) - np.log(p_raw)


def _base(texts: list[str]) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    cps, offsets = core.code_points(texts)
    starts, lengths, doc = core.words(cps, offsets)
    n = len(texts)
    n_words = np.bincount(doc, minlength=n)
    chars = np.bincount(doc, lengths, n).astype(np.int64)
    hit = np.flatnonzero(np.isin(cps, [ord(c) for c in SYMBOLS]))
    symbols = np.bincount(np.searchsorted(offsets, hit, "right") - 1, minlength=n)
    dup = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        dup[i] = len(lines) - len(set(lines))
    h = core.hash_slices(cps, starts, lengths)
    repeat = np.zeros(n, np.int64)
    if len(h) >= 3:
        windows = core.window_hashes(h, 3)
        inside = doc[2:] == doc[:-2]
        at = np.flatnonzero(inside)
        keys = windows[at] ^ core.mix(doc[at].astype(U64) + U64(7))
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        at = at[counts[inverse] > 1]
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[at + k] = True
        repeat = np.bincount(doc[covered], minlength=n)
    return n_words, chars, symbols, dup, repeat


def _score(texts: list[str], weights: np.ndarray, buckets: int) -> np.ndarray:
    found, at = buckets_of(texts, buckets)
    sums = np.bincount(np.repeat(np.arange(len(texts)), np.diff(at)), weights[found], len(texts))
    return sums / np.maximum(np.diff(at), 1)


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, folds: int = FOLDS, quantile: float = QUANTILE) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket, and the threshold."""
    core.small_batches(docs.sparkSession)
    rows = core.id_text(docs)
    own = trusted_texts(rows, trusted.select(F.col("doc_id").cast("long"))).select(F.pmod(F.xxhash64("text"), F.lit(folds)).alias("fold"), "text")
    raw = count_buckets(rows.select("text"), buckets)[0]
    good = count_buckets(own, buckets, folds)
    return log_ratios(raw, good.sum(0)), _threshold(own, raw, good, quantile)


def _threshold(own: DataFrame, raw: np.ndarray, good: np.ndarray, quantile: float) -> float:
    """The score of rank ``floor(quantile * n)`` of the trusted texts that pass the base rules, each without its fold."""
    folds, buckets = good.shape
    weights = np.stack([log_ratios(raw, good.sum(0) - g) for g in good])

    def run(batches):
        for batch in batches:
            for fold, texts in _texts(batch):
                fold, failed = np.array(fold, np.int64), _failed(_base(texts))
                for k in range(folds):
                    mine = [t for t, f, bad in zip(texts, fold, failed, strict=True) if f == k and not bad]
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(mine), np.int64)), pa.array(_score(mine, weights[k], buckets))], ["all", "score"])

    scores, scored = core.stored(own.mapInArrow(run, "all long, score double"), "quality-scores")
    placed, _, path = ranked(scores, ["all"], ["score"], "quality-places")
    found = placed.where(F.col("_at") == int(quantile * placed.count())).select("score").collect()  # one row at most
    core.drop(own.sparkSession, path)
    core.drop(own.sparkSession, scored)
    return found[0][0] if found else -np.inf


def _failed(base: tuple[np.ndarray, ...]) -> np.ndarray:
    return (base[0] < 50) | (100 * base[4] > 50 * base[0])


def _judge(texts: list[str], weights: np.ndarray, threshold: float, buckets: int) -> tuple[np.ndarray, ...]:
    """The base figures, base_failed, score and kept of each text."""
    base = _base(texts)
    score = _score(texts, weights, buckets)
    failed = _failed(base)
    return *base, failed, score, ~failed & (score >= threshold)


def rate(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, quantile: float = QUANTILE) -> DataFrame:
    """Base figures, score and verdict of each document.  ``trusted``: doc_id of trusted documents."""
    weights, threshold = fit(docs, trusted, buckets, quantile=quantile)

    def run(batches):
        for batch in batches:
            for ids, texts in core.groups(batch):
                *figures, failed, score, kept = _judge(texts, weights, threshold, buckets)
                columns = [pa.array(ids, pa.int64()), *(pa.array(x.astype(np.int64)) for x in figures), pa.array(failed), pa.array(score), pa.array(kept)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    return core.id_text(docs).mapInArrow(run, SCHEMA)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic."""
    return labels.where("quality = 1 AND toxic = 0").select("doc_id").distinct()


def filter_documents(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, quantile: float = QUANTILE) -> DataFrame:
    """The documents that stay, with all their columns.  Each row is judged by its own text where it is, so no text moves;
    rows that share an id, or have none, are judged apart."""
    weights, threshold = fit(docs, trusted, buckets, quantile=quantile)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for batch in batches:
            column = batch.column(at).cast(pa.string()).fill_null("")
            kept = [_judge(texts, weights, threshold, buckets)[-1] for _, texts in _texts(pa.RecordBatch.from_arrays([column], ["text"]))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *kept])))

    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # mapInArrow can't pass names with dots
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
