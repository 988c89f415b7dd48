"""Column functions over nucleotide strings, token arrays and CIGAR strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements.
CODES, COMPLEMENTS = "ACGTRYKMBVDHSWN", "TGCAYRMKVBHDSWN"


def reverse_complement(seq: Column) -> Column:
    """The IUPAC reverse complement, upper-cased."""
    return F.reverse(F.translate(F.upper(seq), CODES, COMPLEMENTS))


def orientation(seq: Column, rc: Column) -> Column:
    """``.`` for a palindrome, ``+`` if the sequence is its own canonical form, else ``-``."""
    return F.when(seq == rc, ".").when(seq < rc, "+").otherwise("-")


def canonical_array(tokens: Column) -> Column:
    """The smaller of a token array and its reverse."""
    return F.least(tokens, F.reverse(tokens))


def swap_indels(cigar: Column) -> Column:
    """The CIGAR with query and target exchanged."""
    return F.translate(cigar, "ID", "DI")


def cigar_ops(cigar: Column) -> Column:
    """The operations of a CIGAR as an array of structs (len, op)."""
    lengths, ops = F.regexp_extract_all(cigar, F.lit("([0-9]+)([=XMID])"), F.lit(1)), F.regexp_extract_all(cigar, F.lit("([0-9]+)([=XMID])"), F.lit(2))
    return F.zip_with(lengths, ops, lambda n, o: F.struct(n.cast("bigint").alias("len"), o.alias("op")))


def consumed(ops: Column, kinds: str) -> Column:
    """The bases that the operations in ``kinds`` cover."""
    return F.aggregate(F.filter(ops, lambda x: F.lit(kinds).contains(x.op)), F.lit(0).cast("bigint"), lambda a, x: a + x.len)


def interval_distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Zero for intervals that meet, else the gap between them."""
    return F.greatest(F.lit(0), b0 - a1, a0 - b1)


def gap_distance_score(dr: Column, dq: Column, unit: float, weight: float) -> Column:
    """The chain gap cost: weight * x + log2(1 + x) of the gap difference x in units."""
    x = F.abs(dr - dq) / unit
    return weight * x + F.log2(1 + x)
