"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position gets a vector of radius + 1 bits; for each of the 2^(radius+1) - 1 nonzero vectors v one table keeps the
bits whose vector is not orthogonal to v. The vectors of at most ``radius`` differing bits never span the whole space, so some v is
orthogonal to all of them and its table keeps none of those bits: every pair within the radius collides somewhere.

Distinct fingerprints (not documents) enter the tables. Within a bucket, links are found by breadth-first search over unvisited
members, which yields at most one edge a member and never a list of all pairs; the components of the edges are those of all links.

Where fingerprints only estimate a similarity, several propose. What one fingerprint's links connect in a bucket is a cluster: in a large table mostly of
strangers that meet by chance, whose number grows with the square of the table, so clusters join nothing before the pairs in them are judged by all
fingerprints at once. What the links within that limit connect are families; those linked by the first fingerprints have a label in the tables of
the others, so that a family is proposed about once, not once by each fingerprint. Within a family every pair
that could hold is decided by its shingle sets, in tasks of bounded size that return a spanning forest of the links that hold. A large family is compared
in chunks that share a few pivots first; what these join is one part, and only members of different parts are compared further. So a group
of copies of any size costs in proportion to it; a large family of documents that are just too unlike costs the square of its size in time.

Documents without words have fingerprint zero; null texts have none. Null ids take part as copies, but name no component while another id is there.
Equal fingerprints go to the least id; rows that repeat, with their ids or others, stay rows. Texts of any length are hashed
whole, in runs of a megabyte or one text. Columns other than those named are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, buffers, materialize, mix64, release, slices, table, word_spans
from .components import components, heads

#: Rows of the tables that one group of buckets gets, on average.
GROUP_ROWS = 300_000
#: Members of a family in one block, on average; larger families are compared by blocks with pivots, then by pairs of blocks. Members in a task, on average.
BLOCK, PIVOTS, TASK_ROWS = 2_048, 16, 2_048
#: Fingerprints propose in turns, which begin with these.
PASSES = 0, 1, 4
#: Most documents whose table rows are encoded together.
CHUNK = 1 << 13
#: Most ids that are broadcast to fetch texts for the exact check; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Seed of the shingles' XXH64.
SEED = 42


def masks(radius: int, bits: int = 64, seed: int = 11) -> np.ndarray:
    """Covering masks over the lowest ``bits`` positions, as unsigned words. Table v keeps the positions whose vector is not orthogonal to v.

    The vectors are all nonzero ones in turn, shuffled, so that tables keep nearly equally many."""
    count = (1 << (radius + 1)) - 1
    turns = np.random.default_rng(seed)
    vectors = np.concatenate([turns.permutation(count) + 1 for _ in range(-(-bits // count))])[:bits]
    out = []
    for v in range(1, count + 1):
        kept = [i for i in range(bits) if bin(int(vectors[i]) & v).count("1") % 2 == 1]
        out.append(sum(1 << i for i in kept))
    return np.array(out, dtype=np.uint64)


def shingle_hashes(column: pa.Array, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of lower-cased words, and for each text the index of its first (one more at the end)."""
    data, off = buffers(column)
    starts, ends, first = word_spans(data, off)
    size = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size + 1, out=at[1:])
    source = np.repeat(starts - at[:-1], size + 1) + np.arange(at[-1])
    text = LOWER[data[np.minimum(source, max(len(data) - 1, 0))]] if len(source) else np.zeros(0, np.uint8)
    text[at[1:] - 1] = 0x20
    words = np.diff(first)
    n = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    begin = np.repeat(first[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    last = np.minimum(begin + shingle, np.repeat(first[1:], n)) - 1
    raw, digest = memoryview(text.tobytes()), xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[s:e], seed) for s, e in zip(at[begin].tolist(), (at[last + 1] - 1).tolist())), dtype=np.uint64, count=len(begin))
    return h, bounds


def distinct(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats inside a text, each text's hashes in order."""
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort([h, of])
    h, of = h[order], of[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=len(bounds) - 1))]).astype(np.int64)


#: Each byte's bits, one a byte lane, so that one addition counts eight bits; lanes hold sums of up to 255.
_LANES = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(i)) & np.uint64(1)) << np.uint64(8 * i) for i in range(8))


def fold(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Fingerprints: a bit is 1 if set in over half the hashes of a text."""
    n = np.diff(bounds)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        pieces = -(-n[some] // 255)
        first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
        cuts = np.repeat(bounds[:-1][some] - 255 * first, pieces) + 255 * np.arange(pieces.sum())
        lanes = np.add.reduceat(_LANES[h.astype("<u8").view(np.uint8).reshape(-1, 8)], cuts, axis=0).astype("<u8").view(np.uint8)
        ones = np.add.reduceat(lanes.reshape(-1, 64), first, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > n[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, width: int = 1, once: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, codes): ``width`` 64-bit fingerprints as signed longs, the first from XXH64 and the others from a remix of it.

    Null text: no words. With ``once`` a shingle counts once in a text, however often it is repeated."""

    def compute(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                h, bounds = shingle_hashes(part.column("text"), shingle, SEED)
                if once:
                    h, bounds = distinct(h, bounds)
                codes = np.empty((part.num_rows, width), np.int64)
                for j in range(width):
                    codes[:, j] = fold(mix64(h + np.uint64(j)) if j else h, bounds).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, width), pa.int32()), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "codes"])
        release()

    slim = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return slim.mapInArrow(compute, "doc_id long, codes array<long>")


def shingle_sets(docs: DataFrame, shingle: int, width: int) -> DataFrame:
    """(doc_id, codes, shingles): fingerprints over the distinct shingles of each text, and these as their hashes."""

    def compute(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                h, bounds = distinct(*shingle_hashes(part.column("text"), shingle, SEED))
                codes = np.column_stack([fold(mix64(h + np.uint64(j)) if j else h, bounds) for j in range(width)])
                prints = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, width), pa.int32()), pa.array(codes.view(np.int64).ravel()))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), prints, lists], ["doc_id", "codes", "shingles"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(compute, "doc_id long, codes array<long>, shingles array<long>")


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)


def spanned(codes: np.ndarray, values: np.ndarray, bounds: np.ndarray, limit: int, similarity: float) -> list:
    """A spanning forest (pairs of positions) of all links among some documents, by breadth-first search over unvisited ones.

    Two link if their sets (``values`` within ``bounds``) are similar enough; those that differ in more than ``limit`` bits are not compared."""
    size = np.diff(bounds)
    names, values = np.unique(values, return_inverse=True)
    mark = np.zeros(len(names), bool)
    edges, queue, rest = [], [], np.arange(len(codes))
    while len(rest):
        if queue:
            x = queue.pop()
        else:
            x, rest = rest[0], rest[1:]
        apart = np.bitwise_count(codes[rest] ^ codes[x]).sum(axis=1, dtype=np.int64)
        hit = np.zeros(len(rest), bool)
        open_ = np.flatnonzero((apart <= limit) & (np.minimum(size[rest], size[x]) >= similarity * np.maximum(size[rest], size[x]) - 1e-9))
        if len(open_):
            y = rest[open_]
            own = values[bounds[x] : bounds[x + 1]]
            mark[own] = True
            first = np.cumsum(size[y]) - size[y]
            found = np.r_[0, np.cumsum(mark[values[np.repeat(bounds[y] - first, size[y]) + np.arange(size[y].sum())]])]
            mark[own] = False
            both = found[first + size[y]] - found[first]
            hit[open_] = both >= similarity * (size[x] + size[y] - both) - 1e-9
        if hit.any():
            found = rest[hit]
            edges += [(x, y) for y in found.tolist()]
            queue += found.tolist()
            rest = rest[~hit]
    return edges


def exact_check(docs: DataFrame, shingle: int, similarity: float):
    """A check for ``near_groups``: edges (a, b) that join, in each family (node, component), all documents that links connect.

    Documents link if their sets of shingles have at least this Jaccard similarity; pairs beyond ``limit`` differing bits of ``width``
    fingerprints over distinct shingles are not compared. Rows that share a doc_id count as that document, each of them."""

    def compared(units: DataFrame, width: int, limit: int) -> DataFrame:
        """Edges among the documents of each unit, from rows (doc_id, unit)."""
        members = materialize(units, "members")
        n = members.count()
        ids = members.select("doc_id").distinct()
        few = n <= BROADCAST_IDS
        sets = shingle_sets(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), shingle, width)
        placed = sets.join(F.broadcast(members) if few else members, "doc_id").withColumn("task", F.pmod("unit", F.lit(-(-n // TASK_ROWS) or 1)))

        def link(group: pa.Table) -> pa.Table:
            group = group.sort_by("unit")
            ids, unit = group.column("doc_id").to_numpy(), group.column("unit").to_numpy()
            codes = _lists(group.column("codes"))[0].view(np.uint64).reshape(-1, width)
            values, bounds = _lists(group.column("shingles"))
            cut = np.r_[0, np.flatnonzero(unit[1:] != unit[:-1]) + 1, len(unit)]
            edges = []
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                edges += [(s + x, s + y) for x, y in spanned(codes[s:e], values[bounds[s] : bounds[e]], bounds[s : e + 1] - bounds[s], limit, similarity)]
            ends = ids[np.array(edges, np.int64).reshape(-1, 2)]
            ends = ends[ends[:, 0] != ends[:, 1]]
            release()
            return pa.table({"a": pa.array(ends[:, 0], pa.int64()), "b": pa.array(ends[:, 1], pa.int64())})

        found = placed.select("task", "unit", "doc_id", "codes", "shingles").groupBy("task").applyInArrow(link, "a long, b long")
        return materialize(found, "links")

    def check(families: DataFrame, width: int, limit: int) -> DataFrame:
        blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
        sizes = families.groupBy("component").agg(blocks(F.count(F.lit(1))).alias("blocks"))
        members = materialize(families.join(sizes, "component").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "chunks")
        large = members.where("blocks > 1")
        pivots = large.withColumn("i", F.row_number().over(Window.partitionBy("component").orderBy(F.xxhash64("node", "component"), "node"))).where(F.col("i") <= PIVOTS)
        pivots = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        unit = lambda *of: F.xxhash64(*of).alias("unit")
        chunks = members.select("node", "component", "chunk").unionByName(pivots.select("node", "component", "chunk")).distinct()
        first = compared(chunks.select(F.col("node").alias("doc_id"), unit("component", "chunk")), width, limit)
        if not large.limit(1).count():
            return first
        # members of large families that pivots and chunks have not joined are compared with all others: by blocks of the largest part and of the rest
        joined = components(first).select("node", F.col("component").alias("part"))
        parted = materialize(large.select("node", "component").join(joined, "node", "left").withColumn("part", F.coalesce("part", "node")), "parts")
        main = parted.groupBy("component", "part").count().groupBy("component").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
        sided = parted.join(main, "component").withColumn("rest", F.col("part") != F.col("main"))
        counts = sided.groupBy("component").agg(blocks(F.sum(F.col("rest").cast("int"))).alias("rests"), blocks(F.sum((~F.col("rest")).cast("int"))).alias("mains")).where("rests > 0")
        open_ = materialize(sided.join(counts, "component"), "sides")
        if not open_.limit(1).count():
            return first
        own = F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int")
        blocked = open_.withColumn("own", own)
        with_main = blocked.withColumn("other", F.explode(F.when(F.col("rest"), F.sequence(F.lit(0), F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("rests") - 1))))
        m, r = F.when(F.col("rest"), F.col("other")).otherwise(F.col("own")), F.when(F.col("rest"), F.col("own")).otherwise(F.col("other"))
        across = with_main.select(F.col("node").alias("doc_id"), unit("component", F.lit("main"), m, r))
        among = blocked.where("rest").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)))
        among = among.where("own <> other or rests = 1").select(F.col("node").alias("doc_id"), unit("component", F.lit("rest"), F.least("own", "other"), F.greatest("own", "other")))
        return first.unionByName(compared(across.unionByName(among), width, limit))

    return check


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplaned(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def _encoded(rep: np.ndarray, label: np.ndarray, code: np.ndarray) -> bytes:
    """Rows of a table, those first whose label is not their rep: how many these are, differences of reps by byte planes, which are mostly
    zero and compress, the fingerprints, and these labels."""
    rep, k = rep.view(np.uint64), np.count_nonzero(label != rep)
    return np.int64(k).tobytes() + _planes(np.r_[rep[:1], rep[1:] - rep[:-1]]) + code.astype("<u8").tobytes() + _planes(label[:k].view(np.uint64))


def _decoded(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reps, labels and fingerprints."""
    k, raw = int(np.frombuffer(blob, np.int64, 1)[0]), np.frombuffer(blob, np.uint8)[8:]
    n = (len(raw) - 8 * k) // 16
    rep = np.cumsum(_unplaned(raw[: 8 * n]), dtype=np.uint64).view(np.int64)
    return rep, np.r_[_unplaned(raw[16 * n :]).view(np.int64), rep[k:]], raw[8 * n : 16 * n].view("<u8")


def table_rows(named: DataFrame, kept: np.ndarray, spread: int, fingers: slice = slice(None)) -> DataFrame:
    """(group, rows): all rows (rep, label, code) of the tables of some fingerprints, encoded. A row goes to a group of its table's buckets by the bits that the table keeps; table
    and key follow from group and code."""

    def place(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= CHUNK:
                yield from emit(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from emit(pa.Table.from_batches(held))
        held = []
        release()

    def emit(chunk):
        rep, label = chunk.column("rep").to_numpy(), chunk.column("label").to_numpy()
        codes = _lists(chunk.column("codes"))[0].view(np.uint64).reshape(len(rep), -1)
        order = np.lexsort([rep, label == rep])
        rep, label, codes = rep[order], label[order], codes[order]
        for at in range(codes.shape[1])[fingers]:
            code, groups, blobs = np.ascontiguousarray(codes[:, at]), [], []
            for v, mask in enumerate(kept):
                slot = (mix64(code & mask) % np.uint64(spread)).astype(np.int64)
                order = np.argsort(slot, kind="stable")
                cut = np.r_[0, np.flatnonzero(np.diff(slot[order])) + 1, len(order)]
                for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    groups.append((at * len(kept) + v) * spread + int(slot[order[s]]))
                    blobs.append(_encoded(rep[order[s:e]], label[order[s:e]], code[order[s:e]]))
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(blobs, pa.binary())], ["group", "rows"])

    return named.select("rep", "label", "codes").mapInArrow(place, "group long, rows binary")


def _linker(limit: int, kept: np.ndarray, spread: int):
    def link(group: pa.Table) -> pa.Table:
        """Edges (a, b): in each bucket of the group, a spanning forest of the links within the limit.

        An edge whose ends share a bucket of an earlier table too is left out: that bucket's forest joins them. Edges are thus good for
        components alone; a pair without an edge may well be a link."""
        parts = [_decoded(x) for x in group.column("rows").to_pylist()]
        rep, code = np.concatenate([r for r, _, _ in parts]), np.concatenate([c for _, _, c in parts])
        table_ = np.repeat(group.column("group").to_numpy() // spread, [len(r) for r, _, _ in parts])
        key = code & kept[table_ % len(kept)]
        order = np.lexsort([rep, code, key, table_])
        rep, code, t, k = rep[order], code[order], table_[order], key[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])]
        head = np.flatnonzero(np.r_[True, new[1:] | (code[1:] != code[:-1])])
        # equal fingerprints: all to the least id
        least = np.repeat(head, np.diff(np.r_[head, len(rep)]))
        same = np.flatnonzero(least != np.arange(len(rep)))
        same = same[t[same] % len(kept) == 0]
        originals, copies = rep[least[same]], rep[same]
        rep, code, t = rep[head], code[head], t[head] % len(kept)
        cut = np.r_[np.flatnonzero(new[head]), len(head)]
        size = np.diff(cut)

        lefts, rights = [], []

        def add(left, right):
            lefts.append(left), rights.append(right)

        two = cut[:-1][size == 2]
        two = two[np.bitwise_count(code[two] ^ code[two + 1]) <= limit]
        add(two, two + 1)
        for at, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
            rest, queue = np.arange(at, at + n), []
            while len(rest):
                if queue:
                    x = queue.pop()
                else:
                    x, rest = rest[0], rest[1:]
                hit = np.bitwise_count(code[rest] ^ code[x]) <= limit
                if hit.any():
                    found = rest[hit]
                    add(np.full(len(found), x), found)
                    queue += found.tolist()
                    rest = rest[~hit]
        left, right = np.concatenate(lefts), np.concatenate(rights)
        apart, early = code[left] ^ code[right], np.zeros(len(left), bool)
        for u in range(int(t.max()) if len(left) else 0):
            early |= (apart & kept[u] == 0) & (u < t[left])
        edges = np.unique(np.column_stack([np.r_[originals, rep[left[~early]]], np.r_[copies, rep[right[~early]]]]), axis=0)
        edges = edges[edges[:, 0] != edges[:, 1]]
        return pa.table({"a": pa.array(edges[:, 0], pa.int64()), "b": pa.array(edges[:, 1], pa.int64())})

    return link


def _gatherer(reach: int, kept: np.ndarray, spread: int):
    def gather(group: pa.Table) -> pa.Table:
        """Clusters (cluster, reps): what links within the reach connect in a bucket, named by a hash of the members.

        Members go without a link to one of another label, and so do clusters that are whole in a bucket of an earlier table too, where the same
        links are. So every pair with two labels within the reach in a bucket shares a cluster."""
        rep, label, code = (np.concatenate(x) for x in zip(*[_decoded(x) for x in group.column("rows").to_pylist()]))
        table_ = int(group.column("group")[0].as_py()) // spread % len(kept)
        key = code & kept[table_]
        order = np.lexsort([rep, code, key])
        key = key[order]
        same = key[1:] == key[:-1]
        order = order[np.r_[False, same] | np.r_[same, False]]
        rep, label, code = rep[order], label[order], code[order]
        key = code & kept[table_]
        # each fingerprint's cluster: the first one found
        head = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        once = code[head]
        cut = np.r_[np.flatnonzero(np.r_[True, key[head][1:] != key[head][:-1]]), len(head)] if len(head) else np.zeros(1, np.int64)
        size, into = np.diff(cut), np.arange(len(head))
        two = cut[:-1][size == 2]
        two = two[np.bitwise_count(once[two] ^ once[two + 1]) <= reach]
        into[two + 1] = two
        for at, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
            rest, queue = np.arange(at, at + n), []
            while len(rest):
                if queue:
                    x = queue.pop()
                else:
                    x, rest = rest[0], rest[1:]
                hit = np.bitwise_count(once[rest] ^ once[x]) <= reach
                if hit.any():
                    found = rest[hit]
                    into[found] = into[x]
                    queue += found.tolist()
                    rest = rest[~hit]
        of = np.repeat(into, np.diff(np.r_[head, len(rep)]))
        order = np.lexsort([label, of])
        rep, label, code, of = rep[order], label[order], code[order], of[order]
        cut = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)] if len(of) else np.zeros(1, np.int64)
        taken = np.ones(len(of), bool)
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if label[s] == label[e - 1]:
                taken[s:e] = False
            elif e - s > 2:
                runs = np.flatnonzero(np.r_[True, label[s + 1 : e] != label[s : e - 1], True])
                most = int(np.argmax(np.diff(runs)))
                if runs[most + 1] - runs[most] > 1:
                    taken[s:e] = False
                    for x in [*range(s, s + runs[most]), *range(s + runs[most + 1], e)]:
                        hit = (np.bitwise_count(code[s:e] ^ code[x]) <= reach) & (label[s:e] != label[x])
                        taken[s:e] |= hit
                        taken[x] |= hit.any()
        order = np.lexsort([rep, of])
        order = order[taken[order]]
        rep, code, of = rep[order], code[order], of[order]
        if len(of):
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            n = np.diff(np.r_[first, len(of)])
            apart, new = np.bitwise_or.reduceat(code ^ np.repeat(code[first], n), first), np.ones(len(first), bool)
            for u in range(table_):
                new &= apart & kept[u] != 0
            name = mix64(np.add.reduceat(mix64(rep.view(np.uint64)), first) + n.astype(np.uint64)).view(np.int64)
            rep, n, name = rep[np.repeat(new, n)], n[new], name[new]
        else:
            n, name = of, of
        release()
        return pa.table({"cluster": pa.array(name, pa.int64()), "reps": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(rep, pa.int64()))})

    return gather


def judged(clusters: DataFrame, codes: DataFrame, limit: int) -> DataFrame:
    """Edges (a, b): a spanning forest of the links of each cluster (cluster, reps), between documents (rep, codes) that differ in up to ``limit`` bits of all fingerprints."""
    once = materialize(clusters.distinct(), "clusters")
    tasks = -(-(once.agg(F.sum(F.size("reps"))).first()[0] or 0) // TASK_ROWS) or 1
    members = once.select("cluster", F.explode("reps").alias("rep"))

    def link(group: pa.Table) -> pa.Table:
        group = group.sort_by("cluster")
        rep, cluster = group.column("rep").to_numpy(), group.column("cluster").to_numpy()
        codes = _lists(group.column("codes"))[0].view(np.uint64).reshape(len(rep), -1)
        cut = np.r_[0, np.flatnonzero(cluster[1:] != cluster[:-1]) + 1, len(rep)]
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        two = two[np.bitwise_count(codes[two] ^ codes[two + 1]).sum(axis=1, dtype=np.int64) <= limit]
        lefts, rights = [two], [two + 1]
        for at, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
            rest, queue = np.arange(at, at + n), []
            while len(rest):
                if queue:
                    x = queue.pop()
                else:
                    x, rest = rest[0], rest[1:]
                hit = np.bitwise_count(codes[rest] ^ codes[x]).sum(axis=1, dtype=np.int64) <= limit
                if hit.any():
                    found = rest[hit]
                    lefts.append(np.full(len(found), x)), rights.append(found)
                    queue += found.tolist()
                    rest = rest[~hit]
        return pa.table({"a": pa.array(rep[np.concatenate(lefts)], pa.int64()), "b": pa.array(rep[np.concatenate(rights)], pa.int64())})

    placed = members.join(codes, "rep").withColumn("task", F.pmod("cluster", F.lit(tasks)))
    return placed.select("task", "cluster", "rep", "codes").groupBy("task").applyInArrow(link, "a long, b long")


def near_groups(codes: DataFrame, radius: int = 2, limit: int | None = None, check=None, reach: int | None = None, bits: int = 64) -> DataFrame:
    """(doc_id, codes, component_id) for rows of ``fingerprints``.

    Without ``check``, documents of one fingerprint each link at ``limit`` (the radius unless given) or fewer differing bits. With it, pairs within
    ``radius`` of each other in the lowest ``bits`` of any one of their fingerprints are sure to share a bucket; pairs in a bucket within ``reach`` bits (``limit``
    unless given) of that one and ``limit`` differing bits of all fingerprints at once join families, and the check is given these (node, component)
    with the number of fingerprints and ``limit``: it decides all pairs in a family, up to ``limit`` differing bits."""
    codes = materialize(codes, "codes")
    classes = codes.groupBy("codes").agg(F.min("doc_id").alias("rep"))
    n, width = codes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("codes")), F.lit(1))).first()
    kept = masks(radius, bits)
    spread = max(1, -(-n // GROUP_ROWS))
    limit = radius if limit is None else limit
    reach = limit if reach is None else reach

    if check is None:
        named = classes.where("rep is not null").withColumn("label", F.col("rep"))
        parts = components(table_rows(named, kept, spread).groupBy("group").applyInArrow(_linker(reach, kept, spread), "a long, b long"))
    else:
        # numbers that run on within a partition: their differences are small and compress
        classes = materialize(classes.withColumn("number", F.monotonically_increasing_id()), "classes")
        named = classes.where("rep is not null").select(F.col("number").alias("rep"), "codes")

        def proposed(rows: DataFrame, fingers: slice) -> DataFrame:
            gathered = table_rows(rows, kept, spread, fingers).groupBy("group").applyInArrow(_gatherer(reach, kept, spread), "cluster long, reps array<long>")
            return judged(gathered, named, limit)

        links = None
        for start, end in [x for x in zip(PASSES, [*PASSES[1:], width]) if x[0] < width]:
            # members are labelled by what the fingerprints before link them to: links within one label are known
            labels = named.withColumn("label", F.col("rep")) if links is None else named.join(heads(links).withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("head", "rep").alias("label"), "codes")
            more = materialize(proposed(labels, slice(start, end)), "proposed")
            links = more if links is None else links.unionByName(more)
        parts = components(links)
        families = parts.join(classes.select(F.col("number").alias("node"), "rep"), "node").select(F.col("rep").alias("node"), "component")
        parts = components(check(materialize(families, "families"), width, limit))
    found = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("codes").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    return codes.join(found, codes.codes == found.of, "left").select("doc_id", "codes", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_groups(fingerprints(table(spark, sf_dir, "documents")), 2)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.element_at("codes", 1)), 16, "0")).alias("fingerprint"), "component_id")
