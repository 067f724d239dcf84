"""Adapter clipping by half-local alignment.

The dynamic program runs over a batch of reads of any lengths at once, one NumPy vector a cell, the longest reads first, so that a column of cells
takes those that still have a base there. What a traceback would count is carried forward along the best predecessor, packed in one number: where
the path's diagonal starts, and its neutral pairs, mismatches and matches, which are at most 99. A path begins with a pair at the first base of the
read or of the adapter, so its start and gaps follow from these and its end. Only two columns of cells are kept, and gaps, which few cells take,
are mended by rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MATCH, MISMATCH, GAP, NEUTRAL = np.float32(1), np.float32(-1), np.float32(-5), np.float32(0.1)
FIELDS = ("query_start", "query_end", "target_start", "target_end", "matches", "mismatches", "neutral", "gaps")
_STRUCT = "struct<" + ", ".join(f"{f}: int" for f in FIELDS) + ", score: float>"
ALIGNMENT = ", ".join(f"{f} int" for f in FIELDS) + ", score float"
_X, _N, _START, _COUNT = 7, 14, 21, 127  # bits of the packed state: matches below the mismatches, neutral pairs, start


def _pairs(letter: int, kind) -> tuple[np.ndarray, np.ndarray]:
    """Of an adapter's letter with each byte: the score, and what it adds to the state."""
    unknown = ord("N")
    score, adds = np.full(256, MISMATCH), np.full(256, 1 << _X, kind)
    score[letter], adds[letter] = MATCH, 1
    if letter == unknown:
        score[:], adds[:] = NEUTRAL, 1 << _N
    score[unknown], adds[unknown] = 0 if letter == unknown else NEUTRAL, 1 << _N
    return score, adds


def align(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, adapter: np.ndarray) -> dict[str, np.ndarray]:
    """Alignments of reads with an adapter; a read is ``sizes`` bytes of ``data`` from ``starts`` on, and none is longer than the one before."""
    n, height, width = len(sizes), len(adapter), int(sizes[0])
    kind = np.int32 if width < 900 else np.int64
    pairs = {t: _pairs(t, kind) for t in set(adapter.tolist())}
    live = np.searchsorted(-sizes, -np.arange(width), "left")  # reads longer than x
    border = np.array([0 if y <= 3 else GAP * np.float32(y - 3) for y in range(height)], np.float32)
    last_score, score = np.repeat(border[:, None], n, axis=1), np.empty((height, n), np.float32)
    last, state = np.repeat(-np.arange(1, height + 1, dtype=kind)[:, None] << _START, n, axis=1), np.empty((height, n), kind)
    best, at_best = np.full(n, -1_000_000, np.float32), np.zeros((3, n), kind)
    for x in range(width):
        k = live[x]
        base = data.take(starts[:k] + x).astype(np.intp)
        scores, adds = ({t: p[i].take(base) for t, p in pairs.items()} for i in (0, 1))
        score[0, :k] = scores[adapter[0]]
        np.add(adds[adapter[0]], kind(x << _START), out=state[0, :k])
        for y in range(1, height):
            here, mine = score[y, :k], state[y, :k]
            np.add(last_score[y - 1, :k], scores[adapter[y]], out=here)
            np.add(last[y - 1, :k], adds[adapter[y]], out=mine)
            above, before = score[y - 1, :k], last_score[y, :k]
            closed = y > 3 and y - 3 > x
            gap = (above if closed else np.maximum(above, before)) + GAP
            rows = np.flatnonzero(gap > here)
            if len(rows):
                here[rows] = gap[rows]
                left = np.zeros(len(rows), bool) if closed else before[rows] + GAP > above[rows] + GAP
                mine[rows] = np.where(left, last[y, rows], state[y - 1, rows])
        most = score[:, :k].max(axis=0)
        rows = np.flatnonzero(most > best[:k])
        if len(rows):
            best[rows] = most[rows]
            y = score[:, rows].argmax(axis=0)
            at_best[0, rows], at_best[1, rows], at_best[2, rows] = state[y, rows], x, y
        last_score, score, last, state = score, last_score, state, last
    packed, x, y = at_best
    begin, neutral, mismatches, matches = packed >> _START, packed >> _N & _COUNT, packed >> _X & _COUNT, packed & _COUNT
    query, target = np.maximum(begin, 0), np.maximum(-begin, 0)
    gaps = x - query + y - target - 2 * (matches + mismatches + neutral - 1)
    return {f: v.astype(np.int32) for f, v in zip(FIELDS, (query, x, target, y, matches, mismatches, neutral, gaps))} | {"score": best}


def _align_texts(texts: pa.Array, adapter: str) -> dict[str, np.ndarray]:
    out = {f: np.zeros(len(texts), np.int32) for f in FIELDS} | {"score": np.zeros(len(texts), np.float32)}
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts) or not texts.buffers()[2]:
        return out
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)
    if (data[offsets[0] : offsets[-1]] > 127).any():
        raise ValueError("reads to align are ASCII")
    sizes = np.diff(offsets)
    rows = np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes)]
    for part in np.array_split(rows, max(1, len(rows) // 4096)) if len(rows) else ():
        for f, v in align(data, offsets[part], sizes[part], np.frombuffer(adapter.encode(), np.uint8)).items():
            out[f][part] = v
    return out


def align_all(seqs: pd.Series, adapter: str) -> pd.DataFrame:
    """Alignments of reads of any lengths; an empty read has an empty alignment."""
    return pd.DataFrame(_align_texts(pa.array(seqs, pa.large_string(), from_pandas=True), adapter))


def alignment(adapter: str, column="seq"):
    """The alignment with ``adapter`` as a struct column, computed in Arrow batches."""
    if not 0 < len(adapter) < 100:
        raise ValueError("an adapter has 1 to 99 bases")

    @F.arrow_udf(ALIGNMENT)
    def run(seqs: pa.Array) -> pa.Array:
        found = _align_texts(seqs, adapter)
        return pa.StructArray.from_arrays([pa.array(v) for v in found.values()], [*found])

    return run(F.col(column) if isinstance(column, str) else column)


def cut_position(a: str = "__a", min_alignment: int = 0, length=None):
    """Where to cut, or -1: the first rule that fires."""
    n, c = F.length("seq") if length is None else length, lambda f: F.col(f"{a}.{f}")
    size = c("neutral") + c("matches") + c("mismatches") + c("gaps")
    share = F.when(size > 0, F.floor(c("matches") * 100 / size)).otherwise(0)
    here = c("query_start")
    return (
        F.when(size == 0, -1).when(F.lit(min_alignment) > size, -1)
        .when((c("query_end") == n - 1) & (c("mismatches") == 0), here)
        .when((size > 5) & (c("target_start") == 0) & (share >= 75), here)
        .when((size > 11) & (share >= 80), here)
        .when((n >= 2) & (c("query_end") >= n - 2) & (size <= 5) & (c("matches") >= 3), here)
        .otherwise(-1)
    )


def dispositions(adapter: str = "CCTTAAGG", min_length: int = 5, delta: int = 0, keep_n: bool = False, clipped_only: bool = False, unclipped_only: bool = False, min_alignment: int = 0):
    """Cuts reads and adds ``disposition``: ``kept`` or why a read goes (adapter_only, too_short, no_adapter, adapter_found, has_n)."""

    return lambda df: _disposed(df.withColumn("__a", alignment(adapter)), F.lit(len(adapter)), min_length, delta, keep_n, clipped_only, unclipped_only, min_alignment)


def _disposed(aligned: DataFrame, size, min_length: int = 5, delta: int = 0, keep_n: bool = False, clipped_only: bool = False, unclipped_only: bool = False, min_alignment: int = 0) -> DataFrame:
    """Reads with their alignment ``__a`` cut, and ``disposition``; ``size`` is the adapter's length."""
    # a generator of one row: a filter above it does not pull the alignment below, where it would run once more
    cut = aligned.select("*", F.inline(F.array(F.struct(cut_position("__a", min_alignment).alias("__cut")))))
    keep = F.when(F.col("__cut") > 0, F.col("__cut") + (F.lit(delta) + size if delta > 0 else F.lit(0))).otherwise(F.length("seq"))
    cut = cut.withColumns({"seq": F.substring("seq", F.lit(1), keep), "qual": F.slice("qual", F.lit(1), F.greatest(keep, F.lit(0)))})
    why = (
        F.when(F.col("__cut") == 0, "adapter_only").when(F.length("seq") < min_length, "too_short")
        .when((F.col("__cut") == -1) & clipped_only, "no_adapter").when((F.col("__cut") > 0) & unclipped_only, "adapter_found")
        .when(F.contains("seq", F.lit("N")) & (not keep_n), "has_n").otherwise("kept")
    )
    return cut.withColumn("disposition", why).drop("__a", "__cut")


def clip(adapter: str = "CCTTAAGG", adapter_only: bool = False, **options):
    """The reads that stay; with ``adapter_only`` those that are nothing but adapter, uncut."""
    wanted = "adapter_only" if adapter_only else "kept"
    return lambda df: df.transform(dispositions(adapter, **options)).where(F.col("disposition") == wanted).drop("disposition")


def parse_adapters(lines) -> list[tuple[str, str]]:
    """[(sequence, description)] of a table of adapters: a tab between the two, ``#`` lines are comments, a missing description is the sequence."""
    out = []
    for line in lines:
        if line.startswith("#") or not line.strip():
            continue
        sequence, _, said = line.rstrip("\r\n").partition("\t")
        if not re.fullmatch("[ACGTNacgtn]{1,99}", sequence.strip()):
            raise ValueError(f"bad adapter line: {line!r}")
        out.append((sequence.strip().upper(), said.strip() or sequence.strip()))
    return out


def read_adapters(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """An adapter file is a dimension of a few lines."""
    return parse_adapters([r[0] for r in spark.read.text(path).coalesce(1).collect()])


def clip_table(df: DataFrame, adapters: list[tuple[str, str]], min_length: int = 5, delta: int = 0, keep_n: bool = False, **options) -> DataFrame:
    """Every read clipped by each adapter of a short list [(sequence, description)], with the ``adapter`` it was: one scan, reads times adapters."""
    place = F.explode(F.sequence(F.lit(0), F.lit(len(adapters) - 1))).alias("__which")
    copies = df.select("*", place)
    at = F.when(F.lit(False), F.lit(None).cast(_STRUCT))
    for i, (sequence, _) in enumerate(adapters):
        at = at.when(F.col("__which") == i, alignment(sequence, F.when(F.col("__which") == i, F.col("seq"))))
    sizes = F.element_at(F.array(*[F.lit(len(s)) for s, _ in adapters]), F.col("__which") + 1)
    names = F.element_at(F.array(*[F.lit(d) for _, d in adapters]), F.col("__which") + 1)
    found = copies.withColumn("__a", at)
    done = _disposed(found, sizes, min_length, delta, keep_n, **options)
    return done.where("disposition = 'kept'").withColumn("adapter", names).drop("disposition", "__which")
