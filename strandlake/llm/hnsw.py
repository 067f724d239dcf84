"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one for each shard.

Rows become points: equal vectors are one point that keeps the ``k + 1`` smallest ids of its rows, so no other copy can be among the
nearest. A tree of medians, fitted to a bounded sample of points, cuts space into cells of nearly equal counts; a cell with more points than a
shard holds is split by a hash. A shard's graph has levels drawn from a hash of the point; points enter in batches, upper levels first,
and find their neighbours by searching the graph of those before them (batch mates are compared directly). Lists are pruned by the
usual diversity rule and stored as one flat array a level (row i: the neighbours of point i, padded with -1). A shard's index is one row of
binary columns in a written table; it is shuffled once for every ``UNIT_QUERIES`` queries that visit it.

Queries visit the cells whose centres are nearest. How many is measured on the sample: so many that ``ROUTED`` of the sample's own neighbours
lie in them. Where vectors form clusters that is a few cells at any size of the table; where they have no structure at all it is every cell,
and the work grows with queries times shards. Each visit yields at most k rows a query, which are merged.

Nearness is the cosine, on components scaled by powers of two first, so that neither very large nor very small ones overflow. Vectors that are
null, empty, zero, or hold null or non-finite components take no part, neither do rows with a null id. Vectors of another length
than most form cells of their own and are found by queries of that length. Rows are told apart, not ids: a query's own row is no candidate,
while another row of its id, with the same vector or another, is; a query row that is repeated is answered as often. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Most points of a shard, fewer where vectors are long; the bytes of their double-precision vectors.
SHARD_POINTS, SHARD_BYTES = 8_192, 16 << 20
#: Cells while the table is small, for parallel work, and at most; points of a cell at least.
LEAST_CELLS, MOST_CELLS, CELL_POINTS = 8, 512, 64
#: Bounded sample that the cells and the number of visits are fitted to; its queries; the share of their neighbours in visited cells.
SAMPLE_POINTS, SAMPLE_QUERIES, ROUTED = 16_384, 256, 0.99
#: Queries that are packed together, and that one copy of a shard's index serves.
QUERY_BLOCK, UNIT_QUERIES = 1024, 16_384
#: Links a point makes; points kept open in a search, and while a point enters; points a batch at most.
DEGREE, BREADTH, ENTERING, BATCH = 16, 128, 64, 1024
#: Points of a beam that are opened in one step.
AT_ONCE = 6


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows in double precision times powers of two, so that the largest component is near one; directions stay exact."""
    v = v.astype(np.float64)
    _, exponent = np.frexp(np.abs(v).max(axis=1, initial=0.0))
    return np.ldexp(v, -exponent[:, None])


def _unit(v: np.ndarray) -> np.ndarray:
    v = _scaled(v)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _pruned(x: np.ndarray, point: np.ndarray, near: np.ndarray, degree: int, out: int) -> np.ndarray:
    """Of each point's candidates ``near`` (rows, -1: none) those nearer to it than to any kept before, up to ``degree``; what
    the rule drops fills the list up. ``out`` columns, nearest first within each kind."""
    result = np.full((len(point), out), -1, np.int32)
    for at in range(0, len(point), 256):
        own, c = point[at : at + 256], near[at : at + 256]
        value = np.where(c >= 0, np.matmul(x[c], x[own][:, :, None])[:, :, 0], -np.inf)
        order = np.argsort(-value, axis=1, kind="stable")
        c, value = np.take_along_axis(c, order, 1), np.take_along_axis(value, order, 1)
        vectors = x[c]
        among = np.matmul(vectors, vectors.transpose(0, 2, 1))
        kept = np.zeros(c.shape, bool)
        count = np.zeros(len(c), np.int64)
        for j in range(c.shape[1]):
            keep = ~(kept & (among[:, j, :] > value[:, j : j + 1])).any(axis=1) & (count < degree) & (c[:, j] >= 0)
            kept[:, j] = keep
            count += keep
            if (count >= degree).all():
                break
        rank = np.argsort(~kept, axis=1, kind="stable")[:, :out]
        picked = np.take_along_axis(c, rank, 1)
        result[at : at + 256, : picked.shape[1]] = picked
    return result


class Graph:
    """Levels of flat neighbour arrays. Points are numbered so that those of a level are the first ``len(links[level])``."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.links = vectors, links

    @staticmethod
    def levels(draws: np.ndarray) -> np.ndarray:
        return np.floor(-np.log(np.clip(draws, 1e-12, 1.0)) / np.log(DEGREE)).astype(int)

    @classmethod
    def build(cls, vectors: np.ndarray, level: np.ndarray) -> "Graph":
        """``level`` falls along the points."""
        graph = cls(vectors, [])
        top = int(level.max(initial=0))
        counts = [int((level >= l).sum()) for l in range(top + 1)]
        graph.links = [np.full((n, DEGREE if l else 2 * DEGREE), -1, np.int32) for l, n in enumerate(counts)]
        for l in range(top, -1, -1):
            at = 0
            while at < counts[l]:
                to = min(counts[l], at + min(max(128, at), BATCH))
                graph._enter(l, at, to)
                at = to
        return graph

    def _enter(self, level: int, at: int, to: int) -> None:
        x, links = self.vectors, self.links[level]
        new = np.arange(at, to)
        mates = x[new] @ x[new].T
        np.fill_diagonal(mates, -np.inf)
        want = min(len(new) - 1, ENTERING if at == 0 else DEGREE)
        close = np.argpartition(-mates, want - 1, axis=1)[:, :want] + at if want > 0 else np.zeros((len(new), 0), np.int64)
        if at:
            found, _ = self._beam(x[new], self._descend(x[new], level), level, at, ENTERING)
            close = np.concatenate([found, close], axis=1)
        if not close.shape[1]:
            return
        width = links.shape[1]
        forward = _pruned(x, new, close, DEGREE, DEGREE)
        links[new, :DEGREE] = forward
        # backward links: where there is no room, the diversity rule decides again
        source, target = np.repeat(new, DEGREE), forward.ravel()
        source, target = source[target >= 0], target[target >= 0]
        nearness = np.einsum("nd,nd->n", x[source], x[target])
        order = np.lexsort([-nearness, target])
        source, target = source[order], target[order]
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
        heads = target[first]
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.r_[first, len(target)]))
        incoming = np.full((len(heads), width), -1, np.int64)
        fits = place < width
        incoming[np.repeat(np.arange(len(heads)), np.diff(np.r_[first, len(target)]))[fits], place[fits]] = source[fits]
        incoming[(incoming[:, :, None] == links[heads][:, None, :]).any(axis=2)] = -1
        both = np.concatenate([links[heads], incoming], axis=1)
        size = (both >= 0).sum(axis=1)
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, : 2 * width]
        roomy = size <= width
        links[heads[roomy]] = packed[roomy][:, :width]
        if (~roomy).any():
            links[heads[~roomy]] = _pruned(x, heads[~roomy], packed[~roomy], width, width)

    def _descend(self, queries: np.ndarray, level: int) -> np.ndarray:
        """Entries for ``level``: the nearest points that greedy steps through the levels above lead to."""
        entry = np.zeros(len(queries), np.int64)
        for l in range(len(self.links) - 1, level, -1):
            value = np.einsum("qd,qd->q", queries, self.vectors[entry])
            moving = np.arange(len(queries))
            while len(moving):
                near = self.links[l][entry[moving]]
                v = np.where(near >= 0, np.matmul(self.vectors[near], queries[moving][:, :, None])[:, :, 0], -np.inf)
                best = v.argmax(axis=1)
                better = v[np.arange(len(moving)), best] > value[moving]
                moving, near, v, best = moving[better], near[better], v[better], best[better]
                entry[moving] = near[np.arange(len(moving)), best]
                value[moving] = v[np.arange(len(moving)), best]
        return entry

    def _beam(self, queries: np.ndarray, entry: np.ndarray, level: int, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest found (or -1) among the first ``n`` points of a level, with their cosines, in no order."""
        x, links, q = self.vectors, self.links[level], len(queries)
        width = min(width, n)
        found, value = np.full((q, width), -1, np.int64), np.full((q, width), -np.inf, x.dtype)
        opened, seen = np.ones((q, width), bool), np.zeros((q, n), bool)
        # a few more entries, spread over the level, keep the beam from one corner of the graph
        starts = np.column_stack([np.minimum(entry, n - 1), np.tile(np.linspace(0, n - 1, min(8, n)).astype(np.int64), (q, 1))])
        rows = np.arange(q)
        for c in range(min(starts.shape[1], width)):
            fresh = ~seen[rows, starts[:, c]]
            found[fresh, c], opened[fresh, c] = starts[fresh, c], False
            value[fresh, c] = np.einsum("qd,qd->q", queries[fresh], x[starts[fresh, c]])
            seen[rows, starts[:, c]] = True
        moving = rows
        while True:
            open_value = np.where(opened[moving] | (found[moving] < 0), -np.inf, value[moving])
            picks = np.argpartition(-open_value, min(AT_ONCE, width) - 1, axis=1)[:, :AT_ONCE]
            real = np.isfinite(np.take_along_axis(open_value, picks, 1))
            alive = real.any(axis=1)
            moving, picks, real = moving[alive], picks[alive], real[alive]
            if not len(moving):
                return found, value
            nears = []
            for e in range(picks.shape[1]):
                opened[moving[real[:, e]], picks[real[:, e], e]] = True
                near = np.where(real[:, e : e + 1], links[found[moving, picks[:, e]]], -1)
                near[(near >= 0) & seen[moving[:, None], near]] = -1
                r, c = np.nonzero(near >= 0)
                seen[moving[r], near[r, c]] = True
                nears.append(near)
            near = np.concatenate(nears, axis=1)
            r, c = np.nonzero(near >= 0)
            v = np.full(near.shape, -np.inf, x.dtype)
            v[r, c] = np.einsum("nd,nd->n", queries[moving[r]], x[near[r, c]])
            # only what beats the worst point held can enter
            some = np.flatnonzero((v > value[moving].min(axis=1)[:, None]).any(axis=1))
            if not len(some):
                continue
            who, near, v = moving[some], near[some], v[some]
            ids = np.concatenate([found[who], near], axis=1)
            values = np.concatenate([value[who], v], axis=1)
            done = np.concatenate([opened[who], np.zeros(near.shape, bool)], axis=1)
            top = np.argpartition(-values, width - 1, axis=1)[:, :width]
            found[who], value[who], opened[who] = (np.take_along_axis(y, top, 1) for y in (ids, values, done))

    def search(self, queries: np.ndarray, k: int, breadth: int = BREADTH) -> np.ndarray:
        """For unit queries about the k nearest points (or -1), nearest first."""
        n = len(self.vectors)
        out = np.full((len(queries), min(k, n)), -1, np.int64)
        for at in range(0, len(queries), QUERY_BLOCK):
            part = queries[at : at + QUERY_BLOCK]
            found, value = self._beam(part, self._descend(part, 0), 0, n, max(breadth, k))
            order = np.argsort(-value, axis=1, kind="stable")[:, :k]
            out[at : at + QUERY_BLOCK] = np.take_along_axis(found, order, 1)
        return out


class Cells:
    """A complete binary tree of medians over unit vectors of one length, with the centres of its leaves and the number to visit."""

    def __init__(self, sample: np.ndarray, depth: int):
        n, self.dim = sample.shape
        self.depth, self.visits = depth, 1 << depth
        self.normals, self.cuts = np.zeros(((1 << depth) - 1, self.dim)), np.zeros((1 << depth) - 1)
        leaf = np.zeros(n, np.int64)
        rng = np.random.default_rng(17)
        for node in range((1 << depth) - 1):
            row = np.flatnonzero(leaf == node)
            if len(row) > 1:
                centred = sample[row] - sample[row].mean(axis=0)
                axis = rng.normal(size=self.dim)
                for _ in range(8):  # power steps towards the widest direction
                    axis = centred.T @ (centred @ axis)
                    axis /= np.linalg.norm(axis) or 1.0
                along = sample[row] @ axis
                self.normals[node], self.cuts[node] = axis, np.median(along)
                leaf[row] = 2 * node + 1 + (along > self.cuts[node])
            else:
                leaf[row] = 2 * node + 1
        leaf -= (1 << depth) - 1
        self.centres = np.zeros((1 << depth, self.dim))
        np.add.at(self.centres, leaf, sample)
        length = np.linalg.norm(self.centres, axis=1, keepdims=True)
        self.centres /= np.where(length > 0, length, 1.0)
        if depth and n > 1:
            queries = np.linspace(0, n - 1, min(n, SAMPLE_QUERIES)).astype(int)
            near = sample[queries] @ sample.T
            near[np.arange(len(queries)), queries] = -np.inf
            wanted = np.argpartition(-near, min(5, n - 1) - 1, axis=1)[:, : min(5, n - 1)]
            rank = np.argsort(self.order(sample[queries]), axis=1)
            seen = np.sort(np.take_along_axis(rank, leaf[wanted], 1).ravel())
            self.visits = min(1 << depth, int(seen[int(np.ceil(ROUTED * len(seen))) - 1]) + 1)

    def of(self, unit: np.ndarray) -> np.ndarray:
        node = np.zeros(len(unit), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (np.einsum("nd,nd->n", unit, self.normals[node]) > self.cuts[node])
        return node - ((1 << self.depth) - 1)

    def order(self, unit: np.ndarray) -> np.ndarray:
        return np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")


def _matrix(column, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(-1, width)


def _by_dim(batch):
    """Parts of a batch whose vectors have one length."""
    dims = batch.column("dim").to_numpy(zero_copy_only=False)
    for dim in np.unique(dims).tolist():
        yield dim, batch if (dims == dim).all() else batch.filter(pa.array(dims == dim))


@dataclass
class Index:
    """``points`` (id, vector): the rows that take part; ``shards``: (dim, cell, part) with the graphs; ``parts``: how many shards each cell has."""

    points: DataFrame
    shards: DataFrame
    parts: DataFrame
    cells: Cells | None
    copies: int


_SHARD = "dim int, cell int, part int, points int, vectors binary, copies binary, level_counts binary, links binary"


def _builder(copies: int):
    def build(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        raw = _matrix(group.column("vector"), dim)
        ids = np.full((len(raw), copies), -1, np.int64)
        for i, x in enumerate(group.column("ids").to_pylist()):
            ids[i, : len(x)] = x
        h = group.column("h").to_numpy().view(np.uint64)
        level = Graph.levels(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / float(1 << 53))
        order = np.lexsort([ids[:, 0], h, -level])
        raw, ids = np.ascontiguousarray(raw[order]), ids[order]
        graph = Graph.build(_unit(raw).astype(np.float32), level[order])
        return pa.table({
            **{c: group.column(c).slice(0, 1) for c in ("dim", "cell", "part")}, "points": pa.array([len(raw)], pa.int32()), "vectors": [raw.tobytes()], "copies": [ids.tobytes()],
            "level_counts": [np.array([len(x) for x in graph.links], np.int64).tobytes()], "links": [b"".join(x.tobytes() for x in graph.links)],
        })

    return build


def _celled(points: DataFrame, cells: Cells | None, type_: str) -> DataFrame:
    """(dim, cell, h, vector, ids) of (vector, ids, dim)."""

    def place(batches):
        for batch in batches:
            for dim, part in _by_dim(batch):
                cell = cells.of(_unit(_matrix(part.column("vector"), dim))) if cells is not None and cells.dim == dim else np.zeros(part.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("dim"), pa.array(cell, pa.int32()), *[part.column(c) for c in ("h", "vector", "ids")]], ["dim", "cell", "h", "vector", "ids"])

    return points.select("dim", F.xxhash64("vector").alias("h"), "vector", "ids").mapInArrow(place, f"dim int, cell int, h long, vector {type_}, ids array<long>")


def build_index(rows: DataFrame, copies: int, shard_points: int = SHARD_POINTS, id_column: str = "vec_id", vector_column: str = "embedding") -> Index:
    """Indexes every row that takes part; the cells are fitted to a bounded sample (``SAMPLE_POINTS`` distinct vectors, by a hash)."""
    type_ = "array<float>" if rows.schema[vector_column].dataType.simpleString() == "array<float>" else "array<double>"
    points = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(type_).alias("vector")).where(F.col("id").isNotNull() & F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False)))
    sound = F.forall("vector", lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    zero = F.lit(0.0).cast(type_[6:-1])
    points = materialize(points.where(sound).select("id", F.transform("vector", lambda x: x + zero).alias("vector")), "points")
    # the smallest ids of equal vectors: a window of few rows a group, which map tasks cut down first, so that a common vector stays small
    least = points.withColumn("i", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("i") <= copies)
    classes = least.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = materialize(classes.select("vector", "ids", F.size("vector").alias("dim")), "vectors")
    cells, capacity = None, shard_points
    # the commonest length and its count: one row
    common = classes.groupBy("dim").count().orderBy(F.col("count").desc(), "dim").first()
    if common:
        dim, n = common["dim"], common["count"]
        capacity = max(1, min(shard_points, SHARD_BYTES // (8 * dim)))
        wanted = max(-(-n // capacity), min(LEAST_CELLS, n // CELL_POINTS), 1)
        depth = min(MOST_CELLS, wanted) - 1
        taken = min(SAMPLE_POINTS, max(64, (64 << 20) // (8 * dim)))
        sample = classes.where(F.col("dim") == dim).select("vector").orderBy(F.xxhash64("vector"), "vector").limit(taken).toArrow()
        cells = Cells(_unit(_matrix(sample.column("vector"), dim)), depth.bit_length())
    celled = materialize(_celled(classes, cells, type_), "celled")
    parts = materialize(celled.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(capacity)).cast("int").alias("parts")), "parts")
    placed = celled.join(parts, ["dim", "cell"]).withColumn("part", F.pmod("h", F.col("parts")).cast("int")).drop("parts")
    shards = max(1, int(parts.agg(F.coalesce(F.sum("parts"), F.lit(0))).first()[0]))
    placed = placed.repartition(min(10_000, 2 * shards), "dim", "cell", "part")
    built = placed.groupBy("dim", "cell", "part").applyInArrow(_builder(copies), _SHARD)
    return Index(points, materialize(built, "index"), parts, cells, copies)


def _pieces(queries: DataFrame, cells: Cells | None, wide: np.dtype) -> DataFrame:
    """(dim, cell, n, keys, ids, vectors): for each cell the queries of a batch that visit it."""

    def pack(batches):
        for batch in batches:
            for dim, part in _by_dim(batch):
                raw = _matrix(part.column("vector"), dim)
                key, own = (part.column(c).to_numpy(zero_copy_only=False) for c in ("query", "id"))
                visits = cells.order(_unit(raw))[:, : cells.visits] if cells is not None and cells.dim == dim else np.zeros((len(raw), 1), np.int64)
                rows = []
                for cell in np.unique(visits).tolist():
                    i = np.flatnonzero((visits == cell).any(axis=1))
                    for at in range(0, len(i), QUERY_BLOCK):
                        j = i[at : at + QUERY_BLOCK]
                        rows.append((dim, cell, len(j), key[j].astype(np.int64).tobytes(), own[j].astype(np.int64).tobytes(), raw[j].astype(wide).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["dim", "cell", "n", "keys", "ids", "query_vectors"])

    return queries.select("query", "id", "vector", F.size("vector").alias("dim")).mapInArrow(pack, "dim int, cell int, n int, keys binary, ids binary, query_vectors binary")


def _searcher(k: int, copies: int, wide: np.dtype, own_rows: bool):
    def best(graph, raw, ids, keys, own, original):
        """The k nearest rows of this shard for each query, ties to smaller ids."""
        found = graph.search(_unit(original).astype(np.float32), 2 * k + 2)
        q, c = np.nonzero(found >= 0)
        point = found[q, c]
        a, b = _scaled(original)[q], _scaled(raw[point])
        cosine = np.clip((a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))), -1.0, 1.0)
        mine = ids[point]
        real = mine >= 0
        if own_rows:  # of the query's own vector, one row of its id is the query itself
            self_ = (original[q] == raw[point]).all(axis=1)[:, None] & (mine == own[q][:, None])
            real &= ~(self_ & (np.cumsum(self_, axis=1) == 1))
        row, copy = np.nonzero(real)
        who, which, score = q[row], mine[row, copy], cosine[row]
        order = np.lexsort([which, -score, who])
        who, which, score = who[order], which[order], score[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < k
        return keys[who[keep]], which[keep], score[keep]

    def search(batches):
        last, held = None, ()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("dim", "cell", "part", "points", "keys", "ids", "query_vectors")}
                shard = row["dim"], row["cell"], row["part"]
                if shard != last:
                    dim, n = row["dim"], row["points"]
                    raw = np.frombuffer(batch.column("vectors")[i].as_py(), wide).reshape(n, dim)
                    counts = np.frombuffer(batch.column("level_counts")[i].as_py(), np.int64).tolist()
                    flat, links = np.frombuffer(batch.column("links")[i].as_py(), np.int32), []
                    for l, m in enumerate(counts):
                        width = DEGREE if l else 2 * DEGREE
                        links.append(flat[: m * width].reshape(m, width))
                        flat = flat[m * width :]
                    last, held = shard, (Graph(_unit(raw).astype(np.float32), links), raw, np.frombuffer(batch.column("copies")[i].as_py(), np.int64).reshape(n, copies))
                got = best(*held, np.frombuffer(row["keys"], np.int64), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_vectors"], wide).reshape(-1, row["dim"]))
                yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1]), pa.array(got[2])], ["query", "vec_id", "score"])

    return search


def nearest(index: Index, queries: DataFrame, k: int = 5, own_rows: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row (id, vector) of ``queries``, rows of the indexed table unless ``own_rows`` is false."""
    wide = np.dtype(np.float32 if index.points.schema["vector"].dataType.simpleString() == "array<float>" else np.float64)
    distinct = materialize(queries.groupBy("id", "vector").agg(F.count(F.lit(1)).alias("times")).withColumn("query", F.monotonically_increasing_id()), "queries")
    n = distinct.count()
    packed = _pieces(distinct.repartition(max(1, -(-n // QUERY_BLOCK)), "query"), index.cells, wide).join(index.parts, ["dim", "cell"])
    pieces = materialize(packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"), "pieces")
    # a shard that many queries visit is copied, once for so many of them
    shard = ["dim", "cell", "part"]
    load = materialize(pieces.groupBy(*shard).agg(F.ceil(F.sum("n") / F.lit(UNIT_QUERIES)).cast("int").alias("units")), "load")
    units = int(load.agg(F.coalesce(F.sum("units"), F.lit(0))).first()[0])
    spread = max(1, min(10_000, 2 * units))
    sent = pieces.join(load, shard).withColumn("unit", F.pmod(F.xxhash64("keys"), F.col("units")).cast("int")).drop("units").repartition(spread, *shard, "unit")
    copies = index.shards.join(load, shard).withColumn("unit", F.explode(F.sequence(F.lit(0), F.col("units") - 1))).drop("units").repartition(spread, *shard, "unit")
    met = copies.hint("merge").join(sent, [*shard, "unit"])
    found = met.mapInArrow(_searcher(k, index.copies, wide, own_rows), "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = ranked.join(distinct.select("query", F.col("id").alias("query_id"), "times"), "query")
    return named.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("query_id", "rank", "vec_id", "score")


def op4_hnsw(spark, sf_dir: str) -> DataFrame:
    index = build_index(table(spark, sf_dir, "embeddings"), copies=6)
    return nearest(index, index.points.where("id % 50 = 0"), 5)
