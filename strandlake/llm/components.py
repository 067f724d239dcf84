"""Connected components by alternating large and small stars; each round is a written table, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b). Large star: every larger neighbour of a joins the least of a and its neighbours. Small star: every neighbour not larger."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("a > b")
    heads = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    joined = both.join(heads, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(heads.select("a", F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges`` (a long, b long). Null ends are ignored."""
    current = materialize(edges.where("a <> b").select("a", "b").distinct(), label)
    print_ = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).alias("p")
    before = None
    while True:
        after = current.agg(print_).first()["p"]
        if after == before or after["n"] == 0:
            break
        before = after
        current = materialize(_stars(_stars(current, True), False), label)
    pairs = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def heads(edges: DataFrame, rounds: int = 2, label: str = "heads") -> DataFrame:
    """(node, head): after a few rounds, the least node that each node of ``edges`` but a least one has come to. Nodes of one head are connected;
    connected ones may still have several."""
    current = edges.where("a <> b").select("a", "b").distinct()
    for _ in range(rounds):
        current = materialize(_stars(_stars(current, True), False), label)
    return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("head"))
