"""Exact statistics of each cycle (position in the read)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.reads import reads_count

NUCLEOTIDES = ("A", "C", "G", "T", "N")
MEASURES = ("count", "min", "max", "sum", "mean", "Q1", "med", "Q3", "IQR", "lW", "rW")


def cells(df: DataFrame) -> DataFrame:
    """(cycle, nuc, q, n): the histogram all statistics come from; partial aggregation keeps what is shuffled at cycles x 5 x 109 rows a task."""
    per = df.select(reads_count("name", "qual").alias("c"), F.posexplode(F.arrays_zip(F.split("seq", "").alias("nuc"), F.coalesce("qual", F.array().cast("array<int>")).alias("q"))).alias("i", "x"))
    return per.where("x.nuc <> ''").groupBy((F.col("i") + 1).cast("int").alias("cycle"), F.col("x.nuc").alias("nuc"), F.col("x.q").alias("q")).agg(F.sum("c").alias("n"))


def measures(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """The eleven measures for each group of (keys..., q, n). Order statistics are the elements at ranks count/4, count/2 and 3*count/4 of
    the sorted qualities, found by cumulative counts; without qualities they are null and counts stay."""
    by = Window.partitionBy(*keys)
    rows = histogram.groupBy(*keys, "q").agg(F.sum("n").alias("n"))
    cum = rows.withColumn("cum", F.sum("n").over(by.orderBy("q").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(by))
    at = lambda k: F.min(F.when(F.col("cum") > F.expr(f"total * {k} div 4"), F.col("q")))
    out = cum.groupBy(*keys).agg(F.max("total").alias("count"), F.min("q").alias("min"), F.max("q").alias("max"), F.sum(F.col("q") * F.col("n")).alias("sum"), at(1).alias("Q1"), at(2).alias("med"), at(3).alias("Q3"))
    out = out.withColumn("mean", F.col("sum") / F.col("count")).withColumn("IQR", F.col("Q3") - F.col("Q1"))
    low, high = F.expr("cast(Q1 - (IQR * 3) div 2 as int)"), F.expr("cast(Q3 + (IQR * 3) div 2 as int)")
    return out.withColumns({"lW": F.when(F.col("Q1").isNotNull(), F.greatest(low, "min")), "rW": F.when(F.col("Q3").isNotNull(), F.least(high, "max"))}).select(*keys, *MEASURES)


def cycle_stats(df: DataFrame) -> DataFrame:
    """The 18-column report: cycle's measures, nucleotide counts and the count of the first cycle (``column`` is the cycle)."""
    h = cells(df)
    bases = h.groupBy("cycle").agg(*[F.sum(F.when(F.col("nuc") == b, F.col("n")).otherwise(0)).alias(f"{b}_Count") for b in NUCLEOTIDES])
    joined = measures(h, ["cycle"]).join(bases, "cycle")
    most = F.max(F.when(F.col("cycle") == 1, F.col("count"))).over(Window.partitionBy())
    return joined.withColumn("Max_count", most).withColumnRenamed("cycle", "column")


def cycle_nuc_stats(df: DataFrame) -> DataFrame:
    """(cycle, nuc, measures...) with nuc ALL and each nucleotide that occurs."""
    h = cells(df)
    return measures(h.select("cycle", F.explode(F.array(F.lit("ALL"), F.col("nuc"))).alias("nuc"), "q", "n"), ["cycle", "nuc"])


def cycle_nuc_wide(df: DataFrame) -> DataFrame:
    """The new report: cycle, max_count and X_<measure> for ALL, A, C, G, T, N; what does not occur is null, its count 0."""
    long = cycle_nuc_stats(df)
    wide = long.groupBy("cycle").pivot("nuc", ["ALL", *NUCLEOTIDES]).agg(*[F.first(m).alias(m) for m in MEASURES])
    wide = wide.fillna(0, [f"{b}_count" for b in NUCLEOTIDES])
    most = F.max(F.when(F.col("cycle") == 1, F.col("ALL_count"))).over(Window.partitionBy())
    return wide.withColumn("max_count", most).select("cycle", "max_count", *[f"{b}_{m}" for b in ("ALL", *NUCLEOTIDES) for m in MEASURES])


def nucleotide_distribution(df: DataFrame) -> DataFrame:
    """(cycle, nuc, n): counts, weighted by the multiplicity of names."""
    return cells(df).groupBy("cycle", "nuc").agg(F.sum("n").alias("n"))


def box_plot(report: DataFrame) -> DataFrame:
    return report.select(F.col("column").alias("cycle"), F.col("Q1").alias("q1"), F.col("lW").alias("lw"), F.col("rW").alias("rw"), F.col("Q3").alias("q3"), "med")


def composition(report: DataFrame) -> DataFrame:
    """(cycle, nuc, pct) for stacked or line charts: percent of the first cycle's reads."""
    pairs = F.array(*[F.struct(F.lit(b).alias("nuc"), F.col(f"{b}_Count").alias("n")) for b in NUCLEOTIDES])
    return report.select(F.col("column").alias("cycle"), "Max_count", F.explode(pairs).alias("p")).select("cycle", "p.nuc", (F.col("p.n") * 100 / F.col("Max_count")).alias("pct"))
