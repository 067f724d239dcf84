"""From raw documents to balanced shards: identify languages, drop near copies and benchmark leaks, mix the sources, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet into the shared folder and hands the
reread table to the next stage. All but the last return the columns they were given, whatever their names. Rows are told apart by id and text:
rows that share a doc_id, or have none, are documents of their own unless their texts are equal too. Null texts, like those without letters, go
with the first stage; an empty table stays empty; texts of any length are processed whole. Of near copies the smallest doc_id stays,
null ids last.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import kd_shards, language, mixing, simhash, spaced_seeds
from strandlake.llm.common import free_name, materialize, table

#: Documents whose main language has a smaller share of their letters go, as do those without letters.
LEAST_SHARE = 0.3
#: Near copies: five-word shingles, Jaccard similarity from here on; so many fingerprints, of which pairs that differ by up to so many among so
#: many bits are sure to meet, and are compared if they differ by no more than ``REACH`` of all 64.
SHINGLE, SIMILARITY, FINGERPRINTS, RADIUS, BITS, REACH = 5, 0.8, 14, 4, 48, 14
#: Pairs whose fingerprints differ by so many standard deviations more than those at that similarity are not compared by their shingle sets.
UNLIKE = 6

#: Most rows of dropped or taken keys that are broadcast.
BROADCAST_IDS = 1_000_000

#: Not expressible: models, fingerprints and substitution-tolerant matching.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.identified(docs, language.fit(docs.select("doc_id", "text", "lang")), LEAST_SHARE)


def differing_bits(similarity: float, bits: int, deviations: float) -> int:
    """Bits in which fingerprints differ at a Jaccard similarity: the mean and so many standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def row_key(*more: str):
    """A row's name: rows that agree in it are equal in id, text and ``more``."""
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in more])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(row_key().alias("row"), "doc_id", "text")
    codes = simhash.fingerprints(rows, SHINGLE, FINGERPRINTS, once=True, id_column="row")
    limit = differing_bits(SIMILARITY, 64 * FINGERPRINTS, UNLIKE)
    check = simhash.exact_check(rows.select(F.col("row").alias("doc_id"), "text"), SHINGLE, SIMILARITY)
    groups = simhash.near_groups(codes, RADIUS, limit, check, REACH, BITS).select(F.col("doc_id").alias("row"), "component_id")
    counted = materialize(groups.groupBy("row").agg(F.min("component_id").alias("group"), F.count(F.lit(1)).alias("n")), "groups")
    crowded = counted.groupBy("group").agg(F.sum("n").alias("n")).where("n > 1").select("group")
    named = counted.join(crowded, "group").join(rows.groupBy("row").agg(F.first("doc_id").alias("id")), "row")
    heads = named.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).getField("row").alias("head"))
    seen = materialize(named.join(heads, "group").select("row", "n", (F.col("row") == F.col("head")).alias("stays")), "seen")
    gone, repeated = seen.where("not stays").select("row"), seen.where("stays and n > 1").select("row")
    # a checked size: a million keys are a few dozen megabytes, and spare the shuffle of all texts; more are joined by a shuffle
    few = seen.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    sent = F.broadcast if few else lambda x: x
    key = free_name(docs, "row")
    gone, repeated = gone.withColumnRenamed("row", key), repeated.withColumnRenamed("row", key)
    kept = docs.withColumn(key, row_key()).join(sent(gone), key, "left_anti")
    if repeated.limit(1).count():
        kept = kept.join(sent(repeated), key, "left_anti").unionByName(kept.join(sent(repeated), key, "left_semi").dropDuplicates([key]))
    return kept.select(*[f"`{c}`" for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spaced_seeds.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as many times as the schedule takes it, to the nearest whole number; without words it is never taken. Equal rows are taken equally often."""
    key, copies = free_name(docs, "row"), free_name(docs, "copies")
    taken = mixing.mix(docs.select("doc_id", "source", "text", row_key("source").alias("row")), keep=["row"])
    taken = taken.groupBy("row").agg(F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias("n")).where("n > 0")
    repeated = docs.withColumn(key, row_key("source")).join(taken.select(F.col("row").alias(key), F.col("n").alias(copies)), key)
    repeated = repeated.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return repeated.select(*[f"`{c}`" for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kd_shards.assign(docs, kd_shards.SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
