"""Collapsing identical reads, and the reverse."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reads import reads_count, reads_count_tabular
from ..schema import FASTA, need_batch


def counts(df: DataFrame) -> DataFrame:
    """(seq, cnt): reads by sequence, with the multiplicity of names that are collapsed already. Works on streams."""
    return df.groupBy("seq").agg(F.sum(reads_count("name", "qual")).alias("cnt"))


def ranked(grouped: DataFrame) -> DataFrame:
    """Adds ``rank``: dense, by count descending, then sequence. Groups of one count are numbered apart, from the sum of the larger counts'
    groups; the many sequences of one count are split by prefix, so that no task numbers all groups."""
    need_batch(grouped, "a rank")
    keyed = grouped.withColumn("__p", F.substring("seq", 1, 6))
    order = Window.orderBy(F.col("cnt").desc(), "__p").rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy("cnt", "__p").agg(F.count(F.lit(1)).alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(order), F.lit(0))).drop("__n")
    inner = F.row_number().over(Window.partitionBy("cnt", "__p").orderBy("seq"))
    return keyed.withColumn("__i", inner).join(base, ["cnt", "__p"]).withColumn("rank", (F.col("__base") + F.col("__i")).cast("long")).drop("__p", "__i", "__base")


def collapse():
    """One FASTA read for each sequence, named rank-count."""

    def run(df: DataFrame) -> DataFrame:
        named = F.concat_ws("-", F.col("rank").cast("string"), F.col("cnt").cast("string"))
        return ranked(counts(df)).select((F.col("rank") - 1).alias("ord"), named.alias("name"), "seq", F.lit(None).cast("string").alias("name2"), F.lit(None).cast("array<int>").alias("qual"), F.lit(FASTA).alias("fmt"))

    return run


def uncollapse(slices: int = 256):
    """Each read as often as its name says, named by a 1-based counter in input order; offsets come from sums of ranges of ``ord``."""

    def run(df: DataFrame) -> DataFrame:
        need_batch(df, "uncollapse")
        counted = df.withColumn("__c", reads_count("name", "qual"))
        edges = counted.approxQuantile("ord", [i / slices for i in range(1, slices)], 0.001) or [0.0]
        part = F.size(F.filter(F.array(*[F.lit(int(e)) for e in sorted(set(edges))]), lambda e: e < F.col("ord")))
        ranged = counted.withColumn("__part", part)
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        base = ranged.groupBy("__part").agg(F.sum("__c").alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
        inner = F.coalesce(F.sum("__c").over(Window.partitionBy("__part").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = ranged.withColumn("__o", inner).join(F.broadcast(base), "__part").withColumn("__o", F.col("__o") + F.col("__base"))
        out = placed.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__c"))))
        number = F.col("__o") + F.col("__k")
        return out.withColumns({"ord": number - 1, "name": number.cast("string")}).drop("__c", "__part", "__base", "__o", "__k")

    return run


def uncollapse_tabular(column: int, value: str = "value"):
    """Each line as often as the count in its ``column``-th tab-separated field; too few fields fail."""
    fields = F.split(value, "\t")
    count = F.when(F.size(fields) < column, F.raise_error(F.concat(F.lit("too few columns: "), F.col(value))).cast("long")).otherwise(reads_count_tabular(F.get(fields, F.lit(column - 1))))
    return lambda df: df.withColumn("__k", F.explode(F.array_repeat(F.lit(1), count.cast("int")))).drop("__k")


def length_histogram(df: DataFrame) -> DataFrame:
    """(len, n): reads by length, with the strict rule for counts in names."""
    from ..functions.reads import reads_count_histogram

    return df.groupBy(F.length("seq").alias("len")).agg(F.sum(reads_count_histogram()).alias("n"))
