"""Read-to-read operators: ``df.transform(op(...))``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import reads as R
from ..schema import FASTA, FASTQ_ASCII, FASTQ_NUMERIC, need_batch


def reverse_complement():
    return lambda df: df.withColumns({"seq": R.reverse_complement(), "qual": F.reverse("qual")})


def mask(threshold: int = 10, char: str = "N"):
    """Bases of quality below the threshold become ``char``; reads without qualities pass unchanged."""
    if len(char) != 1 or threshold < -40:
        raise ValueError("mask takes one character and a threshold of -40 or more")
    masked = F.array_join(F.transform(F.arrays_zip(F.split("seq", "").alias("b"), F.col("qual").alias("q")), lambda x: F.when(x["q"] < threshold, F.lit(char)).otherwise(x["b"])), "")
    return lambda df: df.withColumn("seq", F.when(F.col("qual").isNull() | (F.length("seq") == 0), F.col("seq")).otherwise(masked))


def _swap(source: str, target: str):
    def run(df: DataFrame) -> DataFrame:
        clash = F.raise_error(F.concat(F.lit(f"read already holds {target}: "), F.col("name")))
        seq = F.when(F.contains("seq", F.lit(target)), clash.cast("string")).otherwise(F.translate("seq", source, target))
        return df.withColumns({"seq": seq, "qual": F.lit(None).cast("array<int>"), "name2": F.lit(None).cast("string"), "fmt": F.lit(FASTA)})

    return run


def dna_to_rna():
    """T becomes U; fails on reads that hold U already. The result is FASTA."""
    return _swap("T", "U")


def rna_to_dna():
    return _swap("U", "T")


def numbered(df: DataFrame, column: str, slices: int = 256) -> DataFrame:
    """Adds a dense 1-based counter in ``ord`` order, in two steps: counts of ranges, then numbers within each range.

    The ranges are quantiles of ``ord``, so no task numbers all rows."""
    need_batch(df, "a counter")
    edges = df.approxQuantile("ord", [i / slices for i in range(1, slices)], 0.001) or [0.0]
    part = F.size(F.filter(F.array(*[F.lit(int(e)) for e in sorted(set(edges))]), lambda e: e < F.col("ord")))
    ranged = df.withColumn("__part", part)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inner = F.row_number().over(Window.partitionBy("__part").orderBy("ord"))
    return ranged.withColumn("__i", inner).join(F.broadcast(base), "__part").withColumn(column, (F.col("__base") + F.col("__i")).cast("long")).drop("__part", "__i", "__base")  # at most ``slices`` rows


def rename(by: str = "SEQ"):
    """SEQ: the sequence is the name. COUNT: a 1-based counter of the reads it is given, in input order."""
    if by not in ("SEQ", "COUNT"):
        raise ValueError("rename by SEQ or COUNT")

    def run(df: DataFrame) -> DataFrame:
        if by == "SEQ":
            return df.withColumns({"name": F.col("seq"), "name2": F.when(F.col("qual").isNotNull(), F.col("seq"))})
        name = F.col("__no").cast("string")
        return numbered(df, "__no").withColumns({"name": name, "name2": F.when(F.col("qual").isNotNull(), name)}).drop("__no")

    return run


def convert_quality(numeric: bool = False):
    """Changes how qualities are written, not their values."""
    return lambda df: df.withColumn("fmt", F.when(F.col("qual").isNull(), F.col("fmt")).otherwise(F.lit(FASTQ_NUMERIC if numeric else FASTQ_ASCII)))


def to_fasta(keep_n: bool = False, rename: bool = False):
    """Drops qualities, reads with N unless kept, and - if asked - names reads by a counter of those that stay."""

    def run(df: DataFrame) -> DataFrame:
        kept = df if keep_n else df.where(~F.contains("seq", F.lit("N")))
        kept = kept.withColumns({"qual": F.lit(None).cast("array<int>"), "name2": F.lit(None).cast("string"), "fmt": F.lit(FASTA)})
        return numbered(kept, "__no").withColumn("name", F.col("__no").cast("string")).drop("__no") if rename else kept

    return run


def trim(first: int = 1, last: int | None = None):
    """Keeps bases first..last (1-based). A read shorter than ``first`` is dropped; ``last`` beyond the end cuts nothing."""
    if first < 1 or (last is not None and last < first):
        raise ValueError("trim needs 1 <= first <= last")

    def run(df: DataFrame) -> DataFrame:
        size = (last - first + 1) if last is not None else (1 << 30)
        kept = df.where(F.length("seq") >= first) if first > 1 else df
        return kept.withColumns({"seq": F.substring("seq", first, size), "qual": F.slice("qual", first, size)})

    return run


def _left(df: DataFrame, n) -> DataFrame:
    return df.withColumns({"seq": F.substring("seq", F.lit(1), n), "qual": F.slice("qual", F.lit(1), n)})


def trim_end(count: int, min_length: int = 0):
    """Cuts ``count`` bases off the end; drops reads with nothing, or fewer than ``min_length``, left."""
    n = F.length("seq") - count
    return lambda df: _left(df.where((n > 0) & (n >= min_length)), n)


def quality_trim(threshold: int, min_length: int = 0):
    """Cuts trailing bases of quality below the threshold; drops reads with nothing, or fewer than ``min_length``, left."""
    if threshold == 0:
        raise ValueError("a threshold is required")
    good = F.coalesce(F.array_max(F.transform("qual", lambda q, i: F.when(q >= threshold, i + 1).otherwise(0))), F.lit(0))

    def run(df: DataFrame) -> DataFrame:
        sized = df.withColumn("__n", good).where((F.col("__n") > 0) & (F.col("__n") >= min_length))
        return _left(sized, F.col("__n")).drop("__n")

    return run


def reformat(width: int = 0, keep_empty: bool = False):
    """Sequences wrapped to lines of ``width``; empty ones go unless kept."""
    return lambda df: (df if keep_empty else df.where(F.length("seq") > 0)).withColumn("seq", R.wrap("seq", width))


def tabulate(keep_empty: bool = False):
    """One ``line`` a read: the name, then a tab and the sequence unless it is empty."""
    return lambda df: (df if keep_empty else df.where(F.length("seq") > 0)).select("ord", F.concat_ws("\t", "name", F.nullif("seq", F.lit(""))).alias("line"))
