"""Benchmark decontamination by spaced seeds.

A mask selects some of the tokens in a short window and ignores the others, so a substituted token spoils only the windows that
select it. Hashes of the selected tokens of benchmark items are joined with those of documents; around each hit the item is laid on the
document along that diagonal and compared token by token. A document is contaminated by an item if an aligned stretch of at least
``LEAST_TOKENS`` tokens (or the whole item, if it is shorter) holds at least 80 % equal tokens.

1. Items give their seeds, a row each, and a bit filter of at most ``FILTER_BITS`` bits of them.
2. Documents stream past once, whatever the benchmark's size, and send the seeds that the filter lets pass. The filter only spares
   traffic: what it lets pass wrongly finds no partner in the join.
3. The join of seeds gives (document, item, diagonal), each once. Texts of the documents that take part meet their items in groups of
   about ``GROUP_DOCS`` documents and are compared there.

Tokens are runs of ASCII letters, digits and non-ASCII bytes, with A-Z lower-cased. Null and empty texts match nothing; items without tokens
match nothing; repeated rows are reported once for each (doc_id, item_id), with the best stretch; a null item_id counts as -1. Ties between
stretches: the later one. Texts of any length are read whole. Rows are told apart by id and text, so of rows that share a
doc_id only the contaminated ones go. Other columns may have any name; empty tables give, or leave out, no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, RollingHash, buffers, free_name, materialize, mix64, slices, table, word_spans

#: Any stretch with at least 80 % equal tokens fits one of these somewhere: with s substitutions among at least 5 s tokens, runs of equal
#: tokens are either 4 long, or two neighbours of at least 2, or 1 and 3.
MASKS = ("1111", "11011", "10111", "11101")
LEAST_TOKENS = 13
SIMILARITY = 0.8
#: Most bits of the filter (a few megabytes), and bits for each seed while there are fewer; documents of a group.
FILTER_BITS, SEED_BITS, GROUP_DOCS = 26, 256, 1024
#: Most rows that are broadcast to leave contaminated ones out; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and each text's first one (one more at the end)."""
    starts, ends, first = word_spans(data, off, _SEPARATOR)
    return RollingHash(LOWER[data]).spans(starts, ends), first


def seeds(token: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the mask fits in a text, and the hash of the tokens it selects there."""
    span = len(mask)
    n = len(token) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + span <= last)
    h = np.full(n, np.uint64(int(mask, 2)))
    for i, c in enumerate(mask):
        if c == "1":
            h = (h + token[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
    return at, mix64(h[at])


def _segments(equal: np.ndarray) -> tuple[int, int]:
    """Longest stretch [i, j) of a row of comparisons with at least 80 % equal, beginning and ending on equal tokens."""
    n = len(equal)
    rise = np.concatenate([[0], np.cumsum(np.where(equal, 1 - SIMILARITY, -SIMILARITY))])
    low = np.minimum.accumulate(rise)
    best = (0, 0)
    order = np.searchsorted(-low, -(rise + 1e-9), side="left")  # first i with rise[i] <= rise[j]
    for j in np.flatnonzero(np.arange(n + 1) - order > 0).tolist():
        i = int(order[j])
        if j - i > best[1] - best[0]:
            best = (i, j)
    return best


def _worthwhile(items, docs, hits: np.ndarray, least: int) -> list[list[int]]:
    """The (document, item, diagonal) hits with enough equal tokens in all to hold a stretch that counts. ``items`` and ``docs`` as ``tokens`` gives them."""
    (there, of), (token, first) = items, docs
    d, i, shift = hits.T
    a, z = np.maximum(of[i], first[d] - shift), np.minimum(of[i + 1], first[d + 1] - shift)
    keep = []
    need = SIMILARITY * np.minimum(least, np.diff(of)[i]) - 1e-9
    for at in range(0, len(hits), 20_000):  # bounded memory
        part = slice(at, at + 20_000)
        n = z[part] - a[part]
        cut = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(a[part] - cut[:-1], n) + np.arange(cut[-1])
        equal = np.concatenate([[0], np.cumsum(there[place] == token[place + np.repeat(shift[part], n)])])
        keep.append(equal[cut[1:]] - equal[cut[:-1]] >= need[part])
    return hits[np.concatenate(keep)].tolist() if keep else []


def overlaps(items, docs, hits: np.ndarray, least: int = LEAST_TOKENS) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """For (document, item) of the hits: matched tokens, length, start and end of the best stretch that counts.

    A diagonal is the difference between places of a token in the concatenated documents and items."""
    (there, of), (token, first) = items, docs
    size = np.diff(of)
    out: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for d, i, shift in _worthwhile(items, docs, hits, least):
        a = max(int(of[i]), int(first[d]) - shift)
        z = min(int(of[i + 1]), int(first[d + 1]) - shift)
        s, e = _segments(there[a:z] == token[a + shift : z + shift])
        if e - s >= min(least, int(size[i])):
            matched = int((there[a + s : a + e] == token[a + s + shift : a + e + shift]).sum())
            row = (matched, e - s, a + s + shift - int(first[d]), a + e + shift - int(first[d]))
            if row > out.get((d, i), (-1,)):
                out[d, i] = row
    return out


def _item_seeds(items: DataFrame, masks) -> DataFrame:
    """(h, item, at): seeds of items (item, text), ``at`` counted in the item; those shorter than any mask have one, of all their tokens."""
    short = min(map(len, masks))

    def run(batches):
        for batch in batches:
            token, first = tokens(*buffers(batch.column("text")))
            item, size = batch.column("item").to_numpy(zero_copy_only=False), np.diff(first)
            for mask in (*masks, *("1" * n for n in range(1, short))):
                at, h = seeds(token, first, mask)
                owner = np.searchsorted(first, at, side="right") - 1
                if mask not in masks:
                    whole = size[owner] == len(mask)
                    at, h, owner = at[whole], h[whole], owner[whole]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(item[owner]), pa.array((at - first[owner]).astype(np.int32))], ["h", "item", "at"])

    return items.select("item", "text").mapInArrow(run, "h long, item long, at int")


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)


def _filter(found: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A bit for each of two probes of every seed, as bytes, and the count of bits as a power of two. Words are joined on executors; their number is bounded."""
    bits = min(FILTER_BITS, max(10, (n * SEED_BITS).bit_length()))
    probes = F.explode(F.array(F.shiftrightunsigned("h", 64 - bits), F.col("h").bitwiseAND(F.lit((1 << bits) - 1)))).alias("p")
    words = found.select(probes).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).toArrow()
    held = np.zeros(max(1, 1 << (bits - 6)), np.int64)
    held[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return held.view(np.uint8), bits


def verified(docs: DataFrame, benchmark: DataFrame, masks=MASKS, least: int = LEAST_TOKENS) -> DataFrame:
    """key, doc_id, item_id, item_tokens, matched, length, start, end for each row (key, doc_id, text) and item that overlap; ``key`` names a row."""
    items = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), "text").distinct()
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
    found = materialize(_item_seeds(items, masks), "seeds")
    n = found.count()
    held, bits = _filter(found, n)
    # an item with few seeds may be shorter than any mask
    few = found.groupBy("item").count().where("count = 1").limit(1).count()
    lengths = range(1, min(map(len, masks))) if few else ()

    def pick(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                key = part.column("key").to_numpy()
                token, first = tokens(*buffers(part.column("text")))
                for mask in (*masks, *("1" * m for m in lengths)):
                    at, h = seeds(token, first, mask)
                    a, b = _probes(h, bits)
                    maybe = np.flatnonzero((held[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & (held[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1)
                    if len(maybe):
                        at, h = at[maybe], h[maybe]
                        doc = np.searchsorted(first, at, side="right") - 1
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key[doc]), pa.array((at - first[doc]).astype(np.int32))], ["h", "key", "place"])

    hits = docs.select("key", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(pick, "h long, key long, place int")
    pairs = hits.join(found, "h").select("key", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    pairs = materialize(pairs.groupBy("key", "item").agg(F.collect_list("shift").alias("shifts")), "pairs")
    keys = materialize(pairs.select("key").distinct(), "hit")
    m = keys.count()
    groups = max(1, -(-m // GROUP_DOCS))
    group = F.pmod("key", F.lit(groups)).alias("group")
    texts = docs.join(F.broadcast(keys) if m <= BROADCAST_ROWS else keys, "key", "left_semi").select(group, "key", "doc_id", "text").dropDuplicates(["key", "doc_id"])
    laid = pairs.join(items, "item").select(group, "key", "item", "item_id", "text", "shifts")
    schema = "key long, doc_id long, item_id long, item_tokens long, matched long, length long, start long, `end` long"
    out = pa.schema([(c, pa.int64()) for c in ("key", "doc_id", "item_id", "item_tokens", "matched", "length", "start", "end")])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        left = left.combine_chunks()
        key, doc_id = left.column("key").to_numpy(), left.column("doc_id").to_pylist()
        token, first = tokens(*buffers(left.column("text")))
        names, where, inverse = np.unique(right.column("item").to_numpy(), return_index=True, return_inverse=True)
        there, of = tokens(*buffers(right.column("text").take(pa.array(where))))
        item_id = right.column("item_id").to_numpy()[where]
        shifts = right.column("shifts").combine_chunks()
        count = shifts.value_lengths().to_numpy(zero_copy_only=False)
        item, pair_key, shift = np.repeat(inverse, count), np.repeat(right.column("key").to_numpy(), count), shifts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        # rows of one key (the same id and text, or nearly never others) are each compared
        order = np.argsort(key, kind="stable")
        lo, hi = np.searchsorted(key[order], pair_key, "left"), np.searchsorted(key[order], pair_key, "right")
        n = hi - lo
        d = order[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        item, shift = np.repeat(item, n), np.repeat(shift, n)
        hits = np.column_stack([d, item, shift + first[d] - of[item]])
        size = np.diff(of)
        rows = [(int(key[d]), doc_id[d], int(item_id[i]), int(size[i]), *r) for (d, i), r in overlaps((there, of), (token, first), hits, least).items()]
        return pa.table({c: pa.array([r[j] for r in rows], pa.int64()) for j, c in enumerate(out.names)}, schema=out)

    return texts.groupBy("group").cogroup(laid.groupBy("group")).applyInArrow(compare, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text); rows of one key agree in id and text."""
    return docs.select(_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def _key():
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, masks=MASKS, least: int = LEAST_TOKENS) -> DataFrame:
    """``docs``, all columns, less the rows whose text overlaps an item."""
    gone = materialize(verified(_keyed(docs), benchmark, masks, least).select(F.col("key").alias("gone_key"), F.col("doc_id").alias("gone_id")).distinct(), "contaminated")
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    name = free_name(docs, "key")
    kept = docs.withColumn(name, _key()).alias("kept").join((F.broadcast(gone) if few else gone).alias("gone"), (F.col(f"kept.`{name}`") == F.col("gone.gone_key")) & F.col("kept.doc_id").cast("long").eqNullSafe(F.col("gone.gone_id")), "left_anti")
    return kept.select(*[f"`{c}`" for c in docs.columns])


def contaminated(docs: DataFrame, benchmark: DataFrame, masks=MASKS, least: int = LEAST_TOKENS) -> DataFrame:
    """doc_id, item_id, item_tokens, matched, length, start, end (tokens of the document): the best stretch of each pair that overlaps."""
    best = F.max(F.struct("matched", "length", "start", "end", "item_tokens")).alias("b")
    found = verified(_keyed(docs), benchmark, masks, least)
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.item_tokens", "b.matched", "b.length", "b.start", "b.end")


def op6_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
