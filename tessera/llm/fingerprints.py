"""Document fingerprints: bottom-k sketches of word shingles, by DataFrame functions only.

A sketch is the ascending array of the ``K`` smallest distinct 63-bit hashes of a text's shingles of ``WORDS`` words (all
of them if there are fewer).  The sketch of a union is the K smallest of the sketches together, so sketches merge across
parts of a text (with shared border words) and across texts.  Of two sketches: the share of the K smallest of their union
that is in both estimates the resemblance; with ``k`` full, ``(k - 1) / (largest / 2**63)`` estimates the distinct count,
and counts with the resemblance give the containment.  Without a full sketch all of these are exact.

Hashes are 64-bit, so equal texts have equal sketches, and two shingles are confused once in 2**63 pairs.

Defined results: a null text is empty; a text with words, but fewer than WORDS of them, has its whole sequence of words as
its one shingle; without words the sketch is empty.  Two empty sketches have likeness 1, one empty sketch has likeness 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import core

WORDS, K = 5, 128
SPACE = float(1 << 63)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, n: int = WORDS, k: int = K) -> Column:
    """The sketch as array<bigint>."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return _let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(_sketch_words(w, n, k)))


def _sketch_words(words: Column, n: int, k: int) -> Column:
    last = F.greatest(F.size(words) - n + 1, F.lit(1))
    hashes = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, n)).bitwiseAND((1 << 63) - 1))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Hashes in both sketches up to the largest of the k smallest of their union, over the number of these."""
    both = F.array_intersect(a, b)
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(_let(merge(a, b, k), lambda u: F.size(F.array_intersect(both, u)) / F.greatest(F.size(u), F.lit(1))))


def distinct_shingles(a: Column, k: int = K) -> Column:
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / (F.element_at(a, F.greatest(F.size(a), F.lit(1))) / SPACE))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has: the shared count, by resemblance and the union's count, over a's count."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), shared / F.greatest(distinct_shingles(a, k), F.lit(1.0))))


def text_form(a: Column) -> Column:
    """The sketch as a string: hexadecimal hashes in order."""
    return F.array_join(F.transform(a, lambda x: F.hex(x)), " ")


def merge_all(parts: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts.

    Each part brings k hashes at most; they are deduplicated by partial aggregation, and the k smallest are taken by rank,
    so no task holds more than a window frame of one row.
    """
    hashes = parts.select(*keys, F.explode(column).alias("_h")).distinct()
    ranked = hashes.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column))


def ranges(rows: DataFrame, n: int) -> Column:
    """Number of the range of doc_id that a row is in, descending; null ids are last.  Bounds: n - 1 quantiles."""
    bounds = sorted({int(b) for b in rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)}) if n > 1 else []
    edges = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    return F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.size(F.filter(edges, lambda e: e > F.col("doc_id"))))


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 3) code points replaced by the first as many (or all) of the text that follows."""
    n = F.char_length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(following, F.lit(1), third))


def with_next(rows: DataFrame, n: int = WORDS, k: int = K) -> DataFrame:
    """Adds each row's sketch and the text and sketch of the row that follows in descending doc_id (ties: by text; after
    the last row comes the first).

    Rows are dealt by ranges of doc_id, one shuffle.  In a range a window looks ahead; its last row takes the first row of
    the next range, of which there is one per range, so no more rows than ranges ever meet in one task.
    """
    tasks = core.tasks(rows.sparkSession)
    rows = rows.withColumn("_range", ranges(rows, 4 * tasks))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    dealt = rows.repartition(tasks, "_range").withColumn("_sketch", sketch(F.col("text"), n, k))
    inside = Window.partitionBy("_range").orderBy(*order)
    ahead = dealt.withColumns({"_next_text": F.lead("text").over(inside), "_next_sketch": F.lead("_sketch").over(inside)})
    # The first row of each range: its id by a narrow aggregation, then its text.
    tops = rows.groupBy("_range").agg(F.max("doc_id").alias("_top"))
    heads = rows.join(F.broadcast(tops), "_range").where(F.col("doc_id").eqNullSafe(F.col("_top"))).groupBy("_range").agg(F.min("text").alias("_head"))
    by_range = Window.orderBy("_range")
    everything = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = heads.select("_range", F.coalesce(F.lead("_head").over(by_range), F.first("_head").over(everything)).alias("_head")).withColumn("_head_sketch", sketch(F.col("_head"), n, k))
    return ahead.join(following, "_range", "left").select(
        "doc_id", "text", "_sketch", F.coalesce("_next_text", "_head").alias("_next_text"), F.coalesce("_next_sketch", "_head_sketch").alias("_next_sketch")
    )


def fingerprint_documents(docs: DataFrame, n: int = WORDS, k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edit, their likeness, and the likeness to the next text's fingerprint."""
    rows = with_next(core.id_text(docs), n, k).withColumn("_edited", edited(F.col("text"), F.col("_next_text"))).withColumn("_edited_sketch", sketch(F.col("_edited"), n, k))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        text_form(F.col("_sketch")).alias("fingerprint"),
        text_form(F.col("_edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("_sketch"), F.col("_edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("_sketch"), F.col("_next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("_sketch"), k).alias("n_shingles_estimate"),
    )
