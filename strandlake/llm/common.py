"""Helpers shared by the operators: table access, materialising, and byte kernels over Arrow buffers."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII white space of the word pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = "[^\\x20\\x09-\\x0D]+"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only where none is configured and all runs on one machine (tests) a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    made = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not made:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="strandlake-")
        atexit.register(shutil.rmtree, made, True)
        spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores until no column has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def as_text(df: DataFrame, column: str = "text"):
    """The text column with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, TypeError, AttributeError):
    _TRIM = None


def release() -> None:
    """Returns what this process has freed to the system: workers go on to other tasks, and would keep what the largest one took."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


# --- byte kernels --------------------------------------------------------------------------------------------------

_MULT = (0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, family: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a family's multiplier and of its inverse modulo 2^64, at least n + 1 of them."""
    if len(_POWERS.get(family, ((),))[0]) <= n:
        size = max(n + 1, 1 << 20)
        tables = []
        for base in (_MULT[family], pow(_MULT[family], -1, 1 << 64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            tables.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[family] = tuple(tables)
    return _POWERS[family]


_BYTE_CODES = [np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1) for seed in (20240229, 20250301)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class RollingHash:
    """64-bit hashes of any span of a byte buffer, from one prefix sum; equal bytes have equal hashes everywhere. The two families are independent."""

    def __init__(self, data: np.ndarray, family: int = 0):
        n = len(data)
        up, self.down = _powers(n + 1, family)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODES[family][data] * up[:n], out=self.prefix[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64(self.raw(start, end) + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all k-byte strings, by start."""
        n = len(self.prefix) - k
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix64((self.prefix[k:] - self.prefix[:-k]) * self.down[:n] + np.uint64(k))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    width = np.int64 if large else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    if column.null_count:  # a null may cover bytes
        lengths = np.where(np.asarray(column.is_valid()), np.diff(off), 0)
        if lengths.sum() != off[-1] - off[0]:
            return buffers(column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b""))
    data = np.frombuffer(raw, dtype=np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words of all texts, and for each text the index of its first word (one more at the end)."""
    inside = ~is_space[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def slices(batch: pa.RecordBatch | pa.Table, column: str, most: int):
    """Split into runs of rows whose texts hold about ``most`` bytes; a longer text stands alone."""
    n = batch.num_rows
    if not n:
        return
    _, off = buffers(batch.column(column))
    at = 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to
