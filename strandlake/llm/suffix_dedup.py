"""Exact substring dedup over an enhanced, sparse suffix array.

Suffixes start at content-chosen *anchors*: positions whose k-byte string has the least hash among the windows of
``min_bytes`` bytes that hold it. Every string of ``min_bytes`` bytes holds the anchor it chose, at the same offset
wherever the string occurs, so suffixes at anchors are enough to find all repeats of at least that length, at a
fraction (about 2 / (min_bytes - k + 2)) of the positions. A suffix with the bytes before it, up to the windows' reach, is its *context*; equal
contexts are one suffix with several occurrences.

1. ``pack``: documents become blocks of a bucketed table (co-located joins by block, no further shuffle of texts).
2. ``signal``: each block sends, to the bucket of each anchor, hashes of the k-byte string and of its context with the least
   document that holds it there: one entry for each block and distinct context, however often it is repeated in the block. A bucket answers in a
   few bits: *known* (a smaller document has the context) and *contested* (the k-byte string stands in other contexts).
3. Of each contested context the block with its least document sends the bytes, once. ``repeat_groups`` sorts these suffixes, takes their LCP
   array, scans it with a stack into the tree of common-prefix intervals, parts intervals where left extensions differ,
   and extends each part to both sides until its occurrences differ: the maximal repeat groups with all occurrences.
4. Blocks join the answers into removed spans: an occurrence in a document larger than its group's least is removed over the group's whole
   length, and one of a context that a smaller document holds over the whole context.

Contexts are held equal by 80 bits of two independent hash families beside the string's own 32 and bucket; groups of unequal ones by their bytes.
A passage that stands in every document costs a bucket one entry for each block; blocks and buckets grow with the root of the input beyond
``GROWTH_BYTES``, so entries for each (block, bucket) and a bucket's entries for such a passage stay few.

Null texts are empty; a null doc_id counts as the largest id there is (2^63 - 1, whose own rows it equals); rows that repeat a doc_id are documents of
their own, neither smaller than the other. Texts of any length are taken whole: a longer one than a block is a block. An
empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, buffers, materialize, shared_dir

#: Bytes of text in a block, and of text whose anchors one bucket judges.
BLOCK_BYTES = 2 << 20
BUCKET_BYTES = 3 << 20
#: Bytes of input beyond which blocks and buckets grow with its root; blocks that a task holds, on average, and buckets.
GROWTH_BYTES, BLOCKS_A_TASK, BUCKETS_A_TASK = 64 << 30, 12, 16
NO_ID = np.iinfo(np.int64).max


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each run of ``width`` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = pick(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


class Anchors:
    """Anchors of a buffer of texts. ``low``/``high``: the first and last window start that chose each one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_bytes: int, k: int):
        n, w = len(data), min_bytes - k + 1
        self.hash = RollingHash(data)
        self.data, self.offsets, self.reach = data, offsets, min_bytes - k
        grams = self.hash.grams(k)
        order = ((grams >> np.uint64(33)) + np.uint64(1)).astype(np.uint32)  # never 0, which marks what is no window
        least = _slide(order, w, np.minimum)
        ends = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
        valid = np.arange(len(least)) + min_bytes <= ends
        least = np.where(valid, least, np.uint32(0))
        edge = np.zeros(w - 1, np.uint32)
        most = _slide(np.concatenate([edge, least, edge]), w, np.maximum)[: len(order)]
        at = np.flatnonzero((most == order) & (order > 0)) if len(least) else np.zeros(0, np.int64)
        self.at, self.gram = at, grams[at]
        self.doc = np.searchsorted(offsets, at, side="right") - 1
        self.start = np.maximum(at - self.reach, offsets[self.doc])
        self.end = np.minimum(at + min_bytes, offsets[self.doc + 1])
        shift = (at - self.start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.context = self.hash.spans(self.start, self.end) ^ shift
        self.check = ((RollingHash(data, 1).spans(self.start, self.end) ^ shift) >> np.uint64(48)).astype(np.uint16)
        self.low = self.start
        self.high = np.minimum(at, offsets[self.doc + 1] - min_bytes)


def interval_tree(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Common-prefix intervals of a suffix array by one stack scan: depth, depth of the parent, first and last rank.

    ``lcp[i]`` is the common prefix of ranks i-1 and i (0 at rank 0)."""
    depth, parent, first, last = [], [], [], []
    stack = [(0, 0)]
    for i, value in enumerate([*lcp.tolist()[1:], 0], 1):
        left = i - 1
        while stack[-1][0] > value:
            d, left = stack.pop()
            depth.append(d), parent.append(max(value, stack[-1][0])), first.append(left), last.append(i - 1)
        if stack[-1][0] < value:
            stack.append((value, left))
    return tuple(np.array(x, dtype=np.int64) for x in (depth, parent, first, last))


def _words(rows: np.ndarray) -> np.ndarray:
    """Byte rows as big-endian words: comparing words in order compares the bytes."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    return padded.view(">u8").astype(np.uint64)


def _common(rows: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of byte rows a and b, at most ``most``."""
    same = rows[a] == rows[b]
    n = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1)) if rows.shape[1] else np.zeros(len(a), np.int64)
    return np.minimum(n, most)


def repeat_groups(key: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, length: int):
    """Maximal repeat groups of at least ``length`` bytes around an anchor: (members, group of each, bytes before the anchor, bytes from it on) by group.

    ``right`` holds the bytes from the anchor on and ``left`` those before it, nearest first, of the given counts. For each shift x (bytes
    taken before the anchor) the intervals of the tree at depth length - x are parted where left extensions differ. A part
    holds all occurrences of its string; it is extended as far as they agree, to the left (until extensions are diverse) and to the right."""
    n, reach = len(key), left.shape[1]
    words = _words(right)
    rank = np.lexsort([n_right, *words.T[::-1], key])
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.where(key[rank][1:] == key[rank][:-1], _common(right, rank[1:], rank[:-1], np.minimum(n_right[rank][1:], n_right[rank][:-1])), 0)
    depth, parent, first, last = interval_tree(lcp)
    back = _words(left)[rank]
    left, n_left, right, n_right = left[rank], n_left[rank], right[rank], n_right[rank]
    for x in range(reach + 1):
        alive = np.flatnonzero((depth >= length - x) & (parent < length - x))
        if not len(alive):
            continue
        count = last[alive] - first[alive] + 1
        member = np.repeat(first[alive] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        node = np.repeat(np.arange(len(alive)), count)
        fits = (n_left[member] >= x) & (n_right[member] >= length - x)
        member, node = member[fits], node[fits]
        prefix = back[member][:, : -(-x // 8)].copy()
        if x % 8:
            prefix[:, -1] >>= np.uint64(8 * (8 - x % 8))
        order = np.lexsort([*prefix.T, node])
        member, node, prefix = member[order], node[order], prefix[order]
        fresh = np.ones(len(member), bool)
        fresh[1:] = (node[1:] != node[:-1]) | (prefix[1:] != prefix[:-1]).any(axis=1)
        head = np.flatnonzero(fresh)
        size = np.diff(np.r_[head, len(member)])
        member, size = member[np.repeat(size > 1, size)], size[size > 1]
        if not len(size):
            continue
        head = np.cumsum(size) - size
        group = np.repeat(np.arange(len(size)), size)
        inner = np.flatnonzero(np.r_[False, group[1:] == group[:-1]])
        beside = np.full(len(member), reach, np.int64)
        beside[inner] = _common(left, member[inner], member[inner - 1], np.minimum(n_left[member[inner]], n_left[member[inner - 1]]))
        tail = head + size - 1  # members are in order of their right sides
        yield rank[member], group, np.minimum.reduceat(beside, head), _common(right, member[head], member[tail], np.minimum.reduceat(n_right[member], head))


def _squeeze(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, each by byte planes and compressed, after a header of their sizes."""
    parts = [_squeeze(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T if x.itemsize > 1 and len(x) else x) for x in arrays]
    head = np.array([len(arrays[0]), *map(len, parts)], dtype=np.int32)
    return head.tobytes() + b"".join(parts)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    head = np.frombuffer(blob, np.int32, len(kinds) + 1)
    out, at, n = [], head.nbytes, int(head[0])
    for size, (kind, width) in zip(head[1:], [k if isinstance(k, tuple) else (k, 1) for k in kinds]):
        wide = np.dtype(kind).itemsize
        raw = np.frombuffer(pa.decompress(blob[at : at + int(size)], n * wide * width, codec="zstd", asbytes=True), np.uint8)
        if wide > 1:
            raw = np.ascontiguousarray(raw.reshape(wide, n).T).ravel()
        x = raw.view(kind)
        out.append(x.reshape(-1, width) if width > 1 else x)
        at += int(size)
    return out


class _Block:
    """The documents of a packed block, in the order of packing: by id, null last, then text."""

    def __init__(self, ids: bytes, nulls: bytes, lengths: bytes, text: bytes):
        self.ids, self.nulls = np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool)
        self.lengths = np.frombuffer(lengths, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        raw = pa.decompress(text, int(self.offsets[-1]), codec="zstd", asbytes=True) if self.offsets[-1] else b""
        self.data = np.frombuffer(raw, np.uint8)


def _packer(table: pa.Table) -> pa.Table:
    nulls = np.asarray(table.column("id").is_null())
    ids = table.column("id").fill_null(NO_ID).to_numpy()
    data, off = buffers(table.column("text"))
    texts = data.tobytes()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], nulls[i], texts[off[i] : off[i + 1]]))
    joined = b"".join(texts[off[i] : off[i + 1]] for i in order)
    return pa.table({
        "block": table.column("block").slice(0, 1),
        "ids": [ids[order].astype(np.int64).tobytes()], "nulls": [nulls[order].tobytes()], "lengths": [np.diff(off)[order].astype(np.int64).tobytes()],
        "zipped": [pa.compress(joined, codec="zstd", asbytes=True)],
    }, schema=_PACKED)


_PACKED = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("nulls", pa.binary()), ("lengths", pa.binary()), ("zipped", pa.binary())])
_SIGNAL = "bucket long, block long, entries binary"
_ANSWER = "block long, bucket long, answer binary"


class _Entries:
    """A block's anchors by bucket and context. ``order`` sorts them, ``entry`` numbers distinct contexts along it, ``head`` is each one's
    first occurrence (in the block's least document), ``cut`` where the runs of buckets ``names`` begin among entries (one more at the end)."""

    def __init__(self, a: Anchors, n_buckets: int):
        bucket = (a.gram % np.uint64(n_buckets)).astype(np.int64)
        self.order = order = np.lexsort([a.check, a.context, a.gram, bucket])  # stable: equal contexts stay in order of documents
        gram, context, check = a.gram[order], a.context[order], a.check[order]
        new = np.r_[True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]) | (check[1:] != check[:-1])] if len(order) else np.zeros(0, bool)
        self.entry, self.head = np.cumsum(new) - 1, order[new]
        mine = bucket[self.head]
        at = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else np.zeros(0, np.int64)
        self.names, self.cut = mine[at], np.r_[at, len(mine)]


def _tag(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(32)).astype(np.uint32)


def _signaller(min_bytes: int, k: int, n_buckets: int):
    def signal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row["ids"], row["nulls"], row["lengths"], row["zipped"])
                a = Anchors(b.data, b.offsets, min_bytes, k)
                e = _Entries(a, n_buckets)
                tag, context, check, doc = _tag(a.gram[e.head]), a.context[e.head], a.check[e.head], b.ids[a.doc[e.head]]
                # tags rise within a bucket: their steps are small
                blobs = [_pack(np.diff(tag[i:j], prepend=np.uint32(0)), context[i:j], check[i:j], doc[i:j]) for i, j in zip(e.cut[:-1], e.cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(e.names, pa.int64()), pa.array(np.full(len(e.names), row["block"]), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block", "entries"])

    return signal


def _judge(table: pa.Table) -> pa.Table:
    """For each entry - bit 0: a smaller document has the context; bit 1: the anchor's string stands in other contexts too."""
    parts = [_unpack(x.as_buffer().to_pybytes(), np.uint32, np.uint64, np.uint16, np.int64) for x in table.column("entries")]
    sizes = [len(p[0]) for p in parts]
    tag, high, low, doc = (np.concatenate(x) for x in zip(*[(np.cumsum(p[0], dtype=np.uint32), *p[1:]) for p in parts]))
    order = np.lexsort([doc, low, high, tag])
    t, h, c, d = tag[order], high[order], low[order], doc[order]
    new_tag = np.r_[True, t[1:] != t[:-1]]
    new = np.r_[True, (t[1:] != t[:-1]) | (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
    group, owner = np.cumsum(new) - 1, np.cumsum(new_tag) - 1
    contexts = np.bincount(owner, weights=new)
    code = (d > d[new][group]).astype(np.uint8) | ((contexts[owner] > 1).astype(np.uint8) << 1)
    back = np.empty_like(code)
    back[order] = code
    cut = np.cumsum([0, *sizes])
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "answer": pa.array([_squeeze(back[i:j]) for i, j in zip(cut[:-1], cut[1:])], pa.binary())})


def _spans_of(doc: np.ndarray, start: np.ndarray, end: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of spans [start, end) of the block's buffer; each within one document."""
    if not len(start):
        return doc[:0], start[:0], end[:0]
    order = np.argsort(start, kind="stable")
    doc, start, end = doc[order], start[order], end[order]
    far = np.maximum.accumulate(end)
    new = np.r_[True, (start[1:] > far[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(new)
    return doc[first], start[first], far[np.r_[first[1:] - 1, len(start) - 1]]


def _resolver(min_bytes: int, k: int, n_buckets: int):
    reach = min_bytes - k

    def resolve(key, packed: pa.Table, answers: pa.Table) -> pa.Table:
        """Spans that are settled (bucket null), and the contexts of unsettled anchors for each bucket with the positions of their other occurrences."""
        if not packed.num_rows:
            return _SENT.empty_table()
        row = packed.to_pylist()[0]
        b = _Block(row["ids"], row["nulls"], row["lengths"], row["zipped"])
        a = Anchors(b.data, b.offsets, min_bytes, k)
        e = _Entries(a, n_buckets)
        told = {x["bucket"]: x["answer"] for x in answers.to_pylist()}
        code = np.zeros(len(e.head), np.uint8)
        for name, i, j in zip(e.names.tolist(), e.cut[:-1], e.cut[1:]):
            code[i:j] = np.frombuffer(pa.decompress(told[name], int(j - i), codec="zstd", asbytes=True), np.uint8)
        # the context stands in a smaller document: of another block, or of this one
        least = b.ids[a.doc[e.head]]
        later = b.ids[a.doc[e.order]] > least[e.entry] if len(e.order) else np.zeros(0, bool)
        known = e.order[((code & 1) == 1)[e.entry] | later]
        doc, start, end = _spans_of(a.doc[known], a.low[known], a.high[known] + min_bytes, len(b.ids))
        rows = [(None, _pack(start, end), None)]
        open_ = code == 2
        more = np.flatnonzero(open_[e.entry] & ~later)  # occurrences in the least document
        more = more[e.order[more] != e.head[e.entry[more]]]
        for name, i, j in zip(e.names.tolist(), e.cut[:-1].tolist(), e.cut[1:].tolist()):
            mine = i + np.flatnonzero(open_[i:j])
            if not len(mine):
                continue
            h = e.head[mine]
            n_left, n_right = a.at[h] - a.start[h], a.end[h] - a.at[h]
            right = b.data[np.minimum(a.at[h][:, None] + np.arange(min_bytes), len(b.data) - 1)]
            right[np.arange(min_bytes) >= n_right[:, None]] = 0
            left = b.data[np.maximum(a.at[h][:, None] - 1 - np.arange(reach), 0)]
            left[np.arange(reach) >= n_left[:, None]] = 0
            others = more[np.searchsorted(e.entry[more], i) : np.searchsorted(e.entry[more], j)]
            of = np.searchsorted(mine, e.entry[others]).astype(np.uint32)
            rows.append((int(name), _pack(_tag(a.gram[h]), b.ids[a.doc[h]], a.at[h], n_left.astype(np.uint8), n_right.astype(np.uint8), left, right), _pack(of, a.at[e.order[others]])))
        return pa.table({"block": [row["block"]] * len(rows), "bucket": [x for x, *_ in rows], "entries": [x for _, x, _ in rows], "others": [x for *_, x in rows]}, schema=_SENT)

    return resolve


_SENT = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("entries", pa.binary()), ("others", pa.binary())])


def _scanner(min_bytes: int, k: int):
    reach = min_bytes - k
    kinds = (np.uint32, np.int64, np.int64, np.uint8, np.uint8, (np.uint8, reach), (np.uint8, min_bytes))

    def scan(table: pa.Table) -> pa.Table:
        """Maximal repeat groups of a bucket; each occurrence in a document larger than its group's smallest is a span."""
        parts = [_unpack(x.as_buffer().to_pybytes(), *kinds) for x in table.column("entries")]
        others = [_unpack(x.as_buffer().to_pybytes(), np.uint32, np.int64) for x in table.column("others")]
        cut = np.cumsum([0, *(len(p[0]) for p in parts)])
        tag, doc, at, n_left, n_right, left, right = (np.concatenate(x) for x in zip(*parts))
        # all spans of an occurrence hold its anchor, so their union is one span
        before, after = np.full(len(tag), -1, np.int64), np.full(len(tag), -1, np.int64)
        for member, group, l, d in repeat_groups(tag, left, right, n_left.astype(np.int64), n_right.astype(np.int64), min_bytes):
            least = np.full(group[-1] + 1, NO_ID, np.int64)
            np.minimum.at(least, group, doc[member])
            hit = doc[member] > least[group]
            np.maximum.at(before, member[hit], l[group[hit]])
            np.maximum.at(after, member[hit], d[group[hit]])
        rows = []
        for i, (block, (of, where)) in enumerate(zip(table.column("block").to_pylist(), others)):
            s = slice(cut[i], cut[i + 1])
            own = np.flatnonzero(after[s] >= 0)
            of = of.astype(np.int64)
            of, where = of[(spared := after[s][of] >= 0)], where[spared]
            start = np.r_[at[s][own] - before[s][own], where - before[s][of]]
            end = np.r_[at[s][own] + after[s][own], where + after[s][of]]
            if len(start):
                rows.append((block, _pack(start, end)))
        return pa.table({"block": [x for x, _ in rows], "entries": [x for _, x in rows]}, schema=pa.schema([("block", pa.int64()), ("entries", pa.binary())]))

    return scan


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int64()))])


def _finish(key, packed: pa.Table, spans: pa.Table) -> pa.Table:
    if not packed.num_rows:
        return _RESULT.empty_table()
    row = packed.to_pylist()[0]
    b = _Block(row["ids"], row["nulls"], row["lengths"], row["zipped"])
    pairs = [_unpack(x.as_buffer().to_pybytes(), np.int64, np.int64) for x in spans.column("entries")]
    start, end = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    doc, start, end = _spans_of(np.searchsorted(b.offsets, start, side="right") - 1, start, end, len(b.ids))
    cut, raw = np.searchsorted(doc, np.arange(len(b.ids) + 1)), b.data.tobytes()
    out = []
    for i, (o, n) in enumerate(zip(b.offsets[:-1].tolist(), b.lengths.tolist())):
        digest, p, gone, mine = hashlib.sha256(), o, 0, []
        for s, e in zip(start[cut[i] : cut[i + 1]].tolist(), end[cut[i] : cut[i + 1]].tolist()):
            digest.update(raw[p:s])
            p, gone = e, gone + e - s
            mine += [s - o, e - o]
        digest.update(raw[p : o + n])
        out.append((None if b.nulls[i] else int(b.ids[i]), n, gone, len(mine) // 2, digest.hexdigest(), mine))
    return pa.table(dict(zip(_RESULT.names, map(list, zip(*out)))), schema=_RESULT) if out else _RESULT.empty_table()


def repeated_spans(docs: DataFrame, min_bytes: int = 50, k: int = 24, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """For each document the byte spans covered by strings of ``min_bytes`` bytes that also start in a document with a smaller id.

    ``spans`` holds starts and ends in turn, byte offsets in the text, maximal and disjoint. An empty table gives no rows."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    total, rows = slim.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    total = int(total or 0)
    growth = max(1.0, (total / GROWTH_BYTES) ** 0.5)
    n_blocks = max(1, -(-total // int(block_bytes * growth)), -(-rows // int(20_000 * growth)))
    n_buckets = max(1, -(-total // int(bucket_bytes * growth)))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares, tasks = min(n_blocks, max(least, -(-n_blocks // BLOCKS_A_TASK))), max(least, -(-n_buckets // BUCKETS_A_TASK))
    name = f"strandlake_blocks_{uuid.uuid4().hex}"
    # null ids are spread by text
    block = F.pmod(F.xxhash64(F.coalesce("id", F.xxhash64("text"))), F.lit(n_blocks)).alias("block")
    # one exchange serves the grouping and the buckets
    packed = slim.select(block, "id", "text").repartition(shares, "block").groupBy("block").applyInArrow(_packer, "block long, ids binary, nulls binary, lengths binary, zipped binary")
    (packed.write.format("parquet").option("compression", "uncompressed")
        .bucketBy(shares, "block").sortBy("block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name))
    packed = spark.table(name)
    # the plan holds the files and the buckets; the catalogue need not
    spark.sql(f"drop table {name}")

    signals = packed.mapInArrow(_signaller(min_bytes, k, n_buckets), _SIGNAL).repartition(tasks, "bucket")
    answers = materialize(signals.groupBy("bucket").applyInArrow(_judge, _ANSWER), "answers")
    sent = materialize(packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_resolver(min_bytes, k, n_buckets), "block long, bucket long, entries binary, others binary"), "sent")
    found = sent.where("bucket is not null").repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_scanner(min_bytes, k), "block long, entries binary")
    spans = sent.where("bucket is null").select("block", "entries").unionByName(found)
    return packed.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute_spans(docs: list[tuple[int, bytes]], min_bytes: int) -> dict[int, list[int]]:
    """The same by definition, for tests: distinct ids only."""
    least: dict[bytes, int] = {}
    for d, t in docs:
        for i in range(len(t) - min_bytes + 1):
            g = t[i : i + min_bytes]
            least[g] = min(d, least.get(g, d))
    out = {}
    for d, t in docs:
        gone = np.zeros(len(t) + 2, np.int64)
        for i in range(len(t) - min_bytes + 1):
            if least[t[i : i + min_bytes]] < d:
                gone[i + 1 : i + 1 + min_bytes] = 1
        edge = np.diff(gone)
        out[d] = np.ravel(np.column_stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)])).tolist()
    return out
