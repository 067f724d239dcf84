"""Scalar functions on reads, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _number(text: Column) -> Column:
    return F.nullif(text, F.lit("")).try_cast("long")


def reads_count(name="name", qual=None) -> Column:
    """Multiplicity in a collapsed name: leading digits after the first dash if positive, else 1; always 1 for FASTQ (``qual`` not null)."""
    n = F.greatest(F.coalesce(_number(F.regexp_extract(_col(name), r"^[^-]*-\s*\+?(\d+)", 1)), F.lit(1)), F.lit(1)).cast("long")
    return n if qual is None else F.when(_col(qual).isNotNull(), F.lit(1).cast("long")).otherwise(n)


def reads_count_tabular(field) -> Column:
    """After the first dash, or the whole field without one, a complete positive integer; else 1."""
    rest = F.regexp_replace(_col(field), r"^[^-]*-", "")
    return F.greatest(F.coalesce(_number(F.regexp_extract(rest, r"^\s*\+?(\d+)$", 1)), F.lit(1)), F.lit(1)).cast("long")


def reads_count_histogram(name="name") -> Column:
    """The number after the only dash of a name that ends there, zero included; else 1."""
    return F.coalesce(_number(F.regexp_extract(_col(name), r"^[^-]+-(\d+)$", 1)), F.lit(1)).cast("long")


def complement(seq="seq") -> Column:
    return F.translate(_col(seq), "ACGTNacgtn", "TGCANtgcan")


def reverse_complement(seq="seq") -> Column:
    return F.reverse(complement(seq))


def base_count(seq, base: str) -> Column:
    return F.length(_col(seq)) - F.length(F.replace(_col(seq), F.lit(base)))


def hamming(fragment, other) -> Column:
    """Positions of ``fragment`` that differ from ``other``, aligned on the left; what ``other`` lacks differs."""
    a, b = _col(fragment), _col(other)
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), lambda i: (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))) & (i <= F.length(a)))
    return F.length(a) - F.size(same)


def hamming_to(fragment, code: str, size: int) -> Column:
    """``hamming`` for a literal and fragments of at most ``size`` characters: a sum without lambdas, which stays in generated code."""
    a = _col(fragment)
    terms = [F.when(F.length(a) < i, 0).when(F.substring(a, i, 1) == (code[i - 1] if i <= len(code) else ""), 0).otherwise(1) for i in range(1, size + 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def decode_ascii(text, offset: int = 33) -> Column:
    return F.when(_col(text) == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(_col(text), ""), lambda c: F.ascii(c) - offset))


def decode_numeric(text) -> Column:
    return F.transform(F.split(F.trim(_col(text)), r"\s+"), lambda x: x.cast("int"))


def encode_ascii(qual="qual", offset: int = 33) -> Column:
    return F.array_join(F.transform(_col(qual), lambda q: F.chr(q + offset)), "")


def encode_numeric(qual="qual") -> Column:
    return F.array_join(F.transform(_col(qual), lambda q: q.cast("string")), " ")


def wrap(seq, width: int) -> Column:
    """Lines of exactly ``width`` characters, the remainder last; 0 leaves one line."""
    return _col(seq) if not width else F.regexp_replace(_col(seq), "(.{%d})(?!$)" % width, "$1\n")


def percent(part, whole) -> Column:
    """Integer percent, rounded down; 0 of nothing."""
    return F.when(_col(whole) == 0, F.lit(0)).otherwise(F.floor(_col(part) * 100 / _col(whole))).cast("long")
