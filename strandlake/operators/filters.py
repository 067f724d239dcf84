"""Filters on reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.reads import base_count
from ..schema import LEAST_QUALITY, MOST_QUALITY


def quality_filter(min_quality: int = 0, percent: int = 0):
    """Keeps reads in which at least ``percent`` % of the bases have ``min_quality``. As a count, without sorting: the quality at
    rank len * (100 - percent) / 100 is high enough exactly if no more bases than that rank are low. Percent 0 keeps all."""
    low = F.size(F.filter("qual", lambda q: q < min_quality))
    return lambda df: df.where((low * 100 <= F.size("qual") * (100 - percent) - (F.size("qual") * (100 - percent)) % 100) if percent else F.lit(True))


def artifacts():
    """Drops reads of which all but three bases or fewer are the same nucleotide (N counts as none)."""
    most = F.greatest(*[base_count("seq", b) for b in "ACGT"])
    return lambda df: df.where(most < F.length("seq") - 3)


def without_n():
    return lambda df: df.where(~F.contains("seq", F.lit("N")))


def min_length(n: int):
    return lambda df: df.where(F.length("seq") >= n)


def not_empty():
    return lambda df: df.where(F.length("seq") > 0)


def alphabet(allow_n: bool = True, allow_u: bool = False, lower: bool = False) -> str:
    letters = "ACGT" + "N" * allow_n + "U" * allow_u
    return f"^[{letters}{letters.lower() if lower else ''}]+$"


def problem(pattern: str):
    """Null for a sound read, else what is wrong with it."""
    bad_quality = F.exists("qual", lambda q: q.isNull() | (q < LEAST_QUALITY) | (q > MOST_QUALITY))
    return (
        F.when(F.col("name").isNull(), "missing or wrong id line").when(F.col("seq").isNull() | (F.col("seq") == ""), "missing sequence")
        .when(~F.col("seq").rlike(pattern), "invalid nucleotide").when(F.col("qual").isNotNull() & (F.size("qual") != F.length("seq")), "number of qualities differs from length")
        .when(bad_quality, "quality out of range")
    )


def validate(mode: str = "FAILFAST", allow_n: bool = True, allow_u: bool = False, lower: bool = False):
    """FAILFAST raises on the first bad read, DROPMALFORMED leaves bad reads out, PERMISSIVE adds their ``problem``."""
    wrong = problem(alphabet(allow_n, allow_u, lower))

    def run(df):
        if mode == "PERMISSIVE":
            return df.withColumn("problem", wrong)
        if mode == "DROPMALFORMED":
            return df.where(wrong.isNull())
        if mode != "FAILFAST":
            raise ValueError(f"unknown mode {mode}")
        raised = F.raise_error(F.concat(F.lit("record "), F.col("ord").cast("string"), F.lit(": "), wrong))
        return df.where(F.when(wrong.isNull(), F.lit(True)).otherwise(raised.cast("boolean")))

    return run
