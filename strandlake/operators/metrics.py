"""Run reports: sequences (records) and reads (weighted by the counts in names) before and after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.reads import base_count, percent, reads_count


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("sequences"), F.coalesce(F.sum(reads_count("name", "qual")), F.lit(0)).alias("reads"))


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: sequences and reads in and out, discarded, and integer percent discarded."""
    a, b = totals(before).toDF("input_sequences", "input_reads"), totals(after).toDF("output_sequences", "output_reads")
    both = a.join(b, F.lit(True))  # one row each
    return both.withColumns({"discarded_reads": F.col("input_reads") - F.col("output_reads")}).withColumn("discarded_percent", percent("discarded_reads", "input_reads"))


def masked_report(reads: DataFrame, threshold: int = 10) -> DataFrame:
    """One row, from the reads before masking: reads, those with a base below the threshold, and how many such bases, N included."""
    low = F.coalesce(F.size(F.filter("qual", lambda q: q < threshold)), F.lit(0))
    weight = reads_count("name", "qual")
    return reads.select(weight.alias("w"), F.greatest(low, F.lit(0)).alias("n")).agg(
        F.coalesce(F.sum("w"), F.lit(0)).alias("input_reads"), F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("w"))), F.lit(0)).alias("masked_reads"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("masked_nucleotides"))


def changed_report(reads: DataFrame, nucleotide: str = "T") -> DataFrame:
    """One row, from the reads before T becomes U (or, given U, the reverse): reads, and nucleotides that change."""
    return reads.agg(F.coalesce(F.sum(reads_count("name", "qual")), F.lit(0)).alias("input_reads"), F.coalesce(F.sum(base_count("seq", nucleotide)), F.lit(0)).cast("long").alias("changed_nucleotides"))


def clip_report(disposed: DataFrame) -> DataFrame:
    """(disposition, reads): what became of the reads, those written included."""
    return disposed.groupBy("disposition").agg(F.sum(reads_count("name", "qual")).alias("reads"))


# --- the same as lines of text ---------------------------------------------------------------------------------------

#: What was discarded, by tool (fixed values).
DISCARDED = {"quality_filter": "low-quality", "quality_trim": "too-short", "to_fasta": "low-quality", "artifacts": "artifact"}


def run_lines(report_: DataFrame, tool: str, header: list[str] | None = None) -> list[str]:
    """``report`` as text, after lines that state the parameters; reads that a tool of ``DISCARDED`` left out are named."""
    r = report_.first()
    lines = [*(header or []), f"Input: {r['input_reads']} reads.", f"Output: {r['output_reads']} reads."]
    if tool in DISCARDED:
        lines.append(f"discarded {r['discarded_reads']} ({r['discarded_percent']}%) {DISCARDED[tool]} reads.")
    return lines


def collapse_lines(report_: DataFrame) -> list[str]:
    """``report`` of collapsing or its reverse."""
    r = report_.first()
    return [f"{side.capitalize()}: {r[f'{side}_sequences']} sequences (representing {r[f'{side}_reads']} reads)" for side in ("input", "output")]


def mask_lines(masked: DataFrame, threshold: int, char: str = "N") -> list[str]:
    r = masked.first()
    head = [f"Minimum Quality Threshold: {threshold}", f"Low-quality nucleotides replaced with '{char}'"]
    return [*head, f"Input: {r['input_reads']} reads.", f"Output: {r['input_reads']} reads.", f"Masked reads: {r['masked_reads']}", f"Masked nucleotides: {r['masked_nucleotides']}"]


def change_lines(changed: DataFrame, to_dna: bool = False) -> list[str]:
    r = changed.first()
    return [f"Mode: {'RNA-to-DNA' if to_dna else 'DNA-to-RNA'}", f"Input: {r['input_reads']} reads.", f"Output: {r['input_reads']} reads.", f"Nucleotides changed: {r['changed_nucleotides']}"]


def clip_lines(dispositions: DataFrame, adapter: str, min_length: int = 5, keep_n: bool = False, clipped_only: bool = False, unclipped_only: bool = False) -> list[str]:
    """``clip_report`` as text, with the options it ran with."""
    n = {r["disposition"]: r["reads"] for r in dispositions.collect()}
    lines = [f"Clipping Adapter: {adapter}", f"Min. Length: {min_length}"]
    lines += ["Clipped reads - discarded."] * unclipped_only + ["Non-Clipped reads - discarded."] * clipped_only
    lines += [f"Input: {sum(n.values())} reads.", f"Output: {n.get('kept', 0)} reads."]
    kinds = [("too_short", "too-short", True), ("adapter_only", "adapter-only", True), ("no_adapter", "non-clipped", clipped_only), ("adapter_found", "clipped", unclipped_only), ("has_n", "N", not keep_n)]
    return lines + [f"discarded {n.get(k, 0)} {said} reads." for k, said, shown in kinds if shown]
