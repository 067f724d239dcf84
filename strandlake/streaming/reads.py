"""Reads as streams. Operators that look at one read run on streams unchanged; counts are streaming aggregations; what counts in input
order runs on each micro-batch by ``per_batch``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reads import decode_ascii
from ..operators.collapse import counts
from ..schema import FASTQ_ASCII


def fastq_rows(spark: SparkSession, path: str, offset: int = 33) -> DataFrame:
    """A stream of FASTQ files, whole files at a time: for many files of moderate size, as an instrument writes them."""
    files = spark.readStream.text(path, wholetext=True)
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    records = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(lines) / 4) - 1, F.lit(0))), lambda i: F.struct(*[F.get(lines, (i * 4 + k).cast("int")).alias(f"l{k}") for k in range(4)]))
    rows = files.select(F.posexplode(records).alias("ord", "r")).where("r.l0 is not null and r.l3 is not null")
    return rows.select(F.col("ord").cast("long"), F.substring("r.l0", 2, 1 << 30).alias("name"), F.col("r.l1").alias("seq"), F.substring("r.l2", 2, 1 << 30).alias("name2"), decode_ascii("r.l3", offset).alias("qual"), F.lit(FASTQ_ASCII).alias("fmt"))


def collapse_counts(stream: DataFrame) -> DataFrame:
    """(seq, cnt) as a streaming aggregation, for complete or update mode."""
    return counts(stream)


def windowed_counts(stream: DataFrame, time: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Reads by event-time window and length; rows later than ``late`` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), F.length("seq").alias("len")).agg(F.count(F.lit(1)).alias("n"))


def per_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]):
    """A writer that applies an order-dependent operator to each micro-batch."""
    return stream.writeStream.foreachBatch(lambda df, no: sink(df.transform(operator), no))
