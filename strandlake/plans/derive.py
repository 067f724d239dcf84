"""Reads derived from ordinary tables: sequences and qualities from digests of keys, the same in Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reads import decode_ascii
from ..schema import FASTA, FASTQ_ASCII

#: table: (ord, name, key of the sequence, key of the qualities, length)
READS = {
    "orders": ("o_orderkey", "concat('r', cast(o_orderkey as varchar(20)))", "o_custkey", "o_orderkey", "12 + o_orderkey % 5 * 4"),
    "lineitem": ("l_orderkey * 8 + l_linenumber", "concat(cast(l_orderkey as varchar(20)), '.', cast(l_linenumber as varchar(20)))", "l_partkey", "l_orderkey * 8 + l_linenumber", "12 + l_linenumber * 2"),
    "part": ("p_partkey", "concat(cast(p_partkey as varchar(20)), '-', cast(p_size as varchar(20)))", "p_partkey % 997", "p_partkey", "10 + p_size % 17"),
}
KEYS = {"orders": ("o_orderkey", "o_custkey"), "lineitem": ("l_orderkey", "l_linenumber", "l_partkey"), "part": ("p_partkey", "p_size")}
_HEX, _BASES, _QUALITIES = "0123456789abcdef", "ACGTACGTACGTACGN", "!#&*/38:<>?ADFHI"


def _digest(letter: str, key: str, alphabet: str, size: str) -> str:
    return f"substr(translate(md5(concat('{letter}', cast({key} as varchar(20)))), '{_HEX}', '{alphabet}'), 1, cast({size} as int))"


def columns(table: str) -> dict[str, str]:
    ord_, name, k1, k2, size = READS[table]
    return {"ord": f"cast({ord_} as bigint)", "name": name, "seq": _digest("s", k1, _BASES, size), "q": _digest("q", k2, _QUALITIES, size)}


def sql(table: str) -> str:
    """The DuckDB subquery (ord, name, seq, q)."""
    return "(select " + ", ".join(f"{e} as {k}" for k, e in columns(table).items()) + f" from {table})"


def _spread(df: DataFrame) -> DataFrame:
    """A few files, each of one row group, would keep most cores idle: their few key columns are dealt out. More files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def reads(spark: SparkSession, sf_dir: str, table: str = "lineitem", fasta: bool = False) -> DataFrame:
    """Reads of READ_SCHEMA; without qualities as FASTA."""
    c = columns(table)
    # a generator of one row keeps the digests from being copied into every expression above them
    made = ", ".join(f"'{k}', {e}" for k, e in c.items())
    raw = _spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*KEYS[table])).selectExpr(f"inline(array(named_struct({made})))")
    if fasta:
        return raw.select("ord", "name", "seq", F.lit(None).cast("string").alias("name2"), F.lit(None).cast("array<int>").alias("qual"), F.lit(FASTA).alias("fmt"))
    return raw.select("ord", "name", "seq", F.col("name").alias("name2"), decode_ascii("q").alias("qual"), F.lit(FASTQ_ASCII).alias("fmt"))
