"""The schema of reads."""

from pyspark.sql import types as T

FASTA, FASTQ_ASCII, FASTQ_NUMERIC = "fasta", "fastq_ascii", "fastq_numeric"

#: ``ord`` is the record's ordinal in input order; ``name2`` and ``qual`` are null for FASTA.
READ_SCHEMA = T.StructType([
    T.StructField("ord", T.LongType(), False), T.StructField("name", T.StringType(), False), T.StructField("seq", T.StringType(), False),
    T.StructField("name2", T.StringType(), True), T.StructField("qual", T.ArrayType(T.IntegerType(), False), True), T.StructField("fmt", T.StringType(), False),
])
LEAST_QUALITY, MOST_QUALITY = -15, 93


class OrderedOperatorError(ValueError):
    """An operator that counts in input order was given a streaming DataFrame."""


def need_batch(df, what: str):
    if df.isStreaming:
        raise OrderedOperatorError(f"{what} counts in input order, which a stream has not; use streaming.per_batch")
    return df
