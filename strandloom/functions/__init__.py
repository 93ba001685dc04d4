"""Column functions on sequences and node lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(frame: DataFrame, *names: str) -> DataFrame:
    """The frame, with the columns of these names computed once a row.

    Spark copies a column's expression into each of its uses, and inside a lambda function computes it again for each
    element. It does not do so across a generator, here one of one row.
    """
    held = F.inline(F.array(F.struct(*names)))
    return frame.select(*(c for c in frame.columns if c not in names), held).select(*frame.columns)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def windows(seq: Column, size: int) -> Column:
    """All substrings of `size` letters over ACGT, by place; none for a shorter or null sequence.

    A look-ahead matches at every place, so a sequence is walked over once, whatever its length.
    """
    return F.coalesce(F.regexp_extract_all(seq, F.lit(f"(?=([ACGT]{{{size}}}))"), F.lit(1)), F.array().cast("array<string>"))


def code(seq: Column, k: int) -> Column:
    """A sequence of `k` letters over ACGT as a number of two bits a letter; as it is where that does not fit 64 bits."""
    return F.conv(F.translate(seq, "ACGT", "0123"), 4, 10).cast("long") if k <= 31 else seq


def letters(number: Column, n: int) -> Column:
    """The sequence of `n` letters that code() made a number of."""
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), n, "0"), "0123", "ACGT")


def window_codes(seq: Column, size: int) -> Column:
    """windows() as numbers, for at most 31 letters."""
    digits = F.translate(seq, "ACGT0123", "0123NNNN")
    cut = F.regexp_extract_all(digits, F.lit(f"(?=([0-3]{{{size}}}))"), F.lit(1))
    return F.transform(F.coalesce(cut, F.array().cast("array<string>")), lambda w: F.conv(w, 4, 10).cast("long"))


def label(edge: Column, k: int) -> Column:
    """The source node that an edge is labelled by."""
    return F.substring(edge, 1, k)


def rotate_left(items: Column, by: Column | int) -> Column:
    """Cyclic shift of an array; `by` may exceed its size; an empty array stays empty."""
    n = F.size(items)
    shift = F.pmod(F.lit(by) if isinstance(by, int) else by, F.greatest(n, F.lit(1)))
    return F.concat(F.slice(items, shift + 1, n), F.slice(items, F.lit(1), shift))


def spell(nodes: Column, k: int) -> Column:
    """The sequence along a path of edges: the first label, then each further label's last letter. Empty for no node."""
    rest = F.transform(F.slice(nodes, F.lit(2), F.size(nodes)), lambda e: F.substring(e, k, 1))
    return F.when(F.size(nodes) > 0, F.concat(label(nodes[0], k), F.array_join(rest, ""))).otherwise(F.lit(""))


def split_on(text: Column, by: Column) -> Column:
    """Parts between occurrences of a plain string, without overlap from the left; empty parts are dropped."""
    parts = F.split(F.replace(text, by, F.lit("|")), r"\|", -1)
    return F.filter(parts, lambda x: x != "")


def log2_bucket(mult: Column) -> Column:
    return F.ceil(F.log2(mult)).cast("int")
