"""Column functions over matrices held as ARRAY<ARRAY<DOUBLE>>.

``(4, L)`` matrices have one row per base in the order A, C, G, T; ``(L, 4)`` ones one row per position.  All functions
are compositions of built-in higher-order functions, so they stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ["A", "C", "G", "T"]
#: Background frequencies of A, C, G, T in the information content, and the pseudo-count of its logarithm.
BACKGROUND = [0.27, 0.23, 0.23, 0.27]
EPSILON = 1e-3


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def product(a: Column, b: Column) -> Column:
    """Element by element, of two matrices of one shape."""
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda u, v: u * v))


def column_sums(m: Column) -> Column:
    """Sums over the rows of a (4, L) matrix: an array of length L."""
    zeros = F.transform(F.element_at(m, 1), lambda _: F.lit(0.0))
    return F.aggregate(m, zeros, lambda acc, row: F.zip_with(acc, row, lambda a, x: a + x))


def project(contrib: Column, oh: Column) -> Column:
    """Attribution of the bases that are there; the shapes must agree."""
    same = (F.size(contrib) == F.size(oh)) & (F.size(F.element_at(contrib, 1)) == F.size(F.element_at(oh, 1)))
    return F.when(same, column_sums(product(contrib, oh))).otherwise(F.raise_error(F.lit("contribution and one-hot shapes differ")))


def transpose(m: Column) -> Column:
    width = F.size(F.element_at(m, 1))
    steps = F.when(width > 0, F.sequence(F.lit(1), F.greatest(width, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.transform(m, lambda row: F.element_at(row, i)))


def slice_columns(m: Column, start: Column, stop: Column) -> Column:
    """Columns start .. stop - 1 of a (4, L) matrix."""
    return F.transform(m, lambda row: F.slice(row, start + 1, stop - start))


def center_crop(m: Column, width: int) -> Column:
    """The ``width`` columns in the middle."""
    at = F.floor((F.size(F.element_at(m, 1)) - width) / 2).cast("int")
    return slice_columns(m, at, at + width)


def max_abs(m: Column) -> Column:
    return F.array_max(F.transform(F.flatten(m), F.abs))


def normalise(m: Column) -> Column:
    """Divided by the largest absolute value, if that is above zero."""
    return let(max_abs(m), lambda top: F.transform(m, lambda row: F.transform(row, lambda x: F.when(top > 0, x / top).otherwise(x))))


def sign_correct(m: Column, oh: Column) -> Column:
    """Times the sign of the mean of m * oh; a mean of zero gives an all-zero matrix."""
    return let(F.signum(total(F.flatten(product(m, oh)))), lambda s: F.transform(m, lambda row: F.transform(row, lambda x: s * x)))


def mean_abs(m: Column, signed: bool = False) -> Column:
    """A3: mean over all cells, of absolute values unless ``signed``."""
    cells = F.flatten(m)
    return total(cells if signed else F.transform(cells, F.abs)) / F.size(cells)


def first_argmax(values: Column) -> Column:
    """Position, from 0, of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def log_similarity(p: Column) -> Column:
    """P5: -log10(p + 1e-10), and 0 for NaN."""
    return F.nanvl(-F.log10(p + 1e-10), F.lit(0.0))


def clip(x: Column, top: Column, low: float = 0.05) -> Column:
    """The upper bound is applied last."""
    return F.least(F.greatest(x, F.lit(low)), top)


def information_content(ppm: Column, background: list[float] | None = None) -> Column:
    """per position of an (L, 4) matrix, sum p * log2(p + eps) less the same of the background."""
    bg = background or BACKGROUND
    from math import log2

    rest = sum(b * log2(b) for b in bg)
    return F.transform(ppm, lambda row: total(F.transform(row, lambda p: p * F.log2(p + EPSILON))) - rest)


def ic_trim(ic: Column, least: float, fixed: bool = False) -> Column:
    """struct(start, stop) of the part with information content of ``least`` or more.

    Bounds are change points of the mask: the start is the position before the first rise, and a run that touches an edge
    is bounded by its other edge only.  ``fixed`` bounds the run itself.  Nothing found: (0, 0).
    """
    mask = F.transform(ic, lambda x: x >= least)
    if fixed:
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ic) - 1, F.lit(0))), lambda i: F.get(mask, i))
        first, last = F.array_min(places), F.array_max(places) + 1
    else:
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(ic) - 2, F.lit(0))), lambda i: F.get(mask, i) != F.get(mask, i + 1))
        first, last = F.array_min(places), F.array_max(places) + 1
    return F.struct(F.coalesce(first, F.lit(0)).alias("start"), F.coalesce(last, F.lit(0)).alias("stop"))


def logo_heights(ppm: Column, ic: Column) -> Column:
    """p * information content."""
    return F.zip_with(ppm, ic, lambda row, c: F.transform(row, lambda p: p * c))


def consensus(rows: Column, instance: bool = False) -> Column:
    """the letter of the greatest value at each position; for an instance ``N`` where none is above zero."""
    letters = F.array(*map(F.lit, BASES))

    def letter(row: Column) -> Column:
        best = F.element_at(letters, F.array_position(row, F.array_max(row)).cast("int"))
        return F.when(F.array_max(row) > 0, best).otherwise("N") if instance else best

    return F.array_join(F.transform(rows, letter), "")


def reverse_complement(rows: Column) -> Column:
    """of an (L, 4) matrix."""
    return F.reverse(F.transform(rows, lambda r: F.reverse(r)))


def normalise_ppm(rows: Column) -> Column:
    """Rows divided by their sums; an all-zero row becomes uniform."""
    return F.transform(rows, lambda r: let(total(r), lambda s: F.transform(r, lambda x: F.when(s == 0, 0.25).otherwise(x / F.when(s == 0, 1.0).otherwise(s)))))


def one_hot(sequence: Column) -> Column:
    """(4, L) from a string; other letters give a zero column."""
    letters = F.filter(F.split(F.upper(sequence), ""), lambda c: c != "")
    return indicators(letters, BASES)


def indicators(values: Column, names: list) -> Column:
    """One array per name: 1.0 where a value equals it, else 0.0."""

    def row(name) -> Column:
        return F.transform(values, lambda v: F.when(v == name, 1.0).otherwise(0.0))

    return F.array(*map(row, names))


def fingerprint(oh: Column) -> Column:
    """a key for an encoded sequence."""
    return F.concat_ws("", F.transform(transpose(oh), lambda col: F.concat_ws(",", F.transform(col, lambda x: x.cast("int").cast("string")))))


def aligned_span(start: Column, stop: Column, offset: Column, longest: Column, reverse: Column) -> Column:
    """F8: the span of a seqlet's example under its pattern's window of ``longest`` positions, whose root begins ``offset``
    positions into the seqlet (from its end, on the reverse strand)."""
    low = F.when(reverse, stop - offset - longest).otherwise(start + offset)
    return F.struct(low.alias("start"), (low + longest).alias("stop"))


def windowed(m: Column, start: Column, stop: Column, low: Column, longest: Column) -> Column:
    """the ``longest`` columns of a (4, L) matrix from ``low`` on; where they leave the matrix, columns start .. stop - 1
    with zeros to their right."""
    inside = (low >= 0) & (low + longest <= F.size(F.element_at(m, 1)))
    at, n = F.when(inside, low).otherwise(start), F.when(inside, longest).otherwise(stop - start)
    return F.transform(m, lambda row: F.concat(F.slice(row, at + 1, n), F.array_repeat(F.lit(0.0), (longest - n).cast("int"))))


def describe(cluster: Column, n: Column, text: Column, ic: Column) -> Column:
    """a pattern in one line; a consensus over 20 letters is cut."""
    short = F.when(F.char_length(text) > 20, F.concat(F.substring(text, 1, 20), F.lit("..."))).otherwise(text)
    return F.format_string("Pattern(cluster %s, %s seqlets, %s, mean IC %s)", cluster, n.cast("string"), short, F.format_number(total(ic) / F.size(ic), 2))


def seqlet_label(start: Column, stop: Column, reverse: Column, contrib: Column) -> Column:
    """a seqlet in one line."""
    cells = F.flatten(contrib)
    return F.format_string("Seqlet(%s-%s%s, mean contrib %s)", start.cast("string"), stop.cast("string"), F.when(reverse, "(-)").otherwise("(+)"), F.format_number(total(cells) / (stop - start), 3))


def mean_colour(a: Column, b: Column) -> Column:
    """F16: of two RGBA arrays."""
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)
