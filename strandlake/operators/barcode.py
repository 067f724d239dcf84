"""Demultiplexing by nearest barcode."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reads import hamming_to

UNMATCHED = "unmatched"


def parse_barcodes(lines, mismatches: int = 0) -> list[tuple[str, str]]:
    """[(ident, barcode)] in file order; ``#`` lines are comments, fields are separated by white space."""
    out = []
    for line in lines:
        if line.startswith("#") or not line.strip():
            continue
        fields = line.split()
        ident, code = fields[0], fields[1].upper() if len(fields) > 1 else ""
        if not re.fullmatch("[ACGT]+", code) or not re.fullmatch(r"\w+", ident):
            raise ValueError(f"bad barcode line: {line!r}")
        if out and len(out[0][1]) != len(code):
            raise ValueError("barcodes differ in length")
        if len(code) <= mismatches:
            raise ValueError("barcodes must be longer than the mismatches allowed")
        out.append((ident, code))
    if not out:
        raise ValueError("no barcodes")
    return out


def read_barcodes(spark: SparkSession, path: str, mismatches: int = 0) -> list[tuple[str, str]]:
    """A barcode file is a dimension of a few lines; order matters."""
    return parse_barcodes([r[0] for r in spark.read.text(path).coalesce(1).collect()], mismatches)


def variants(barcodes: list[tuple[str, str]], end: str, partial: int) -> list[tuple[str, str, int]]:
    """(ident, barcode, missing): each barcode and its variants that lack up to ``partial`` characters, from the front at the
    beginning of a read and from the back at its end."""
    return [(i, b[k:] if end == "bol" else b[: len(b) - k], k) for i, b in barcodes for k in range(partial + 1)]


def assign_barcodes(barcodes: list[tuple[str, str]], end: str = "bol", mismatches: int = 1, exact: bool = False, partial: int = 0, partial_penalty: str = "code"):
    """Adds ``barcode`` (the nearest's ident or ``unmatched``) and ``distance`` (null if unmatched). Barcodes are literals on the plan: no join, no shuffle.

    The first of equally near barcodes wins. ``partial_penalty='code'`` counts a missing character as a mismatch and once more."""
    if end not in ("bol", "eol") or partial > mismatches:
        raise ValueError("end is bol or eol, and partial at most mismatches")
    allowed, size = 0 if exact else mismatches, len(barcodes[0][1])
    fragment = F.substring("seq", 1, size) if end == "bol" else F.right("seq", F.lit(size))
    choices = variants(barcodes, end, partial)
    n, ranked = len(choices), []
    for at, (_, code, missing) in enumerate(choices):
        far = hamming_to(fragment, code, size)
        far = far + missing if partial_penalty == "code" else far  # what the variant lacks already differs
        ranked.append(far * n + at)
    best = F.least(*ranked) if n > 1 else ranked[0]  # one number: the distance, then the place in the list
    idents = F.array(*[F.lit(i) for i, *_ in choices])
    distance = F.expr(f"__b div {n}").cast("int")
    hit = (distance <= allowed) & (distance < size)

    def run(df: DataFrame) -> DataFrame:
        near = df.withColumn("__b", best)
        return near.withColumns({"barcode": F.when(hit, F.element_at(idents, F.col("__b") % n + 1)).otherwise(UNMATCHED), "distance": F.when(hit, distance)}).drop("__b")

    return run


def barcode_counts(assigned: DataFrame, barcodes: list[tuple[str, str]], prefix: str = "", suffix: str = "") -> DataFrame:
    """Barcode, Count, Location: each ident with its count, zero included, then ``unmatched`` and ``total``."""
    spark = assigned.sparkSession
    names = spark.createDataFrame([(i,) for i in sorted({i for i, _ in barcodes}) + [UNMATCHED]], "barcode string")
    counted = names.join(assigned.groupBy("barcode").count(), "barcode", "left").select(F.col("barcode").alias("Barcode"), F.coalesce("count", F.lit(0)).alias("Count"), F.concat(F.lit(prefix), "barcode", F.lit(suffix)).alias("Location"))
    return counted.unionByName(assigned.agg(F.lit("total").alias("Barcode"), F.count(F.lit(1)).alias("Count"), F.lit(None).cast("string").alias("Location")))
