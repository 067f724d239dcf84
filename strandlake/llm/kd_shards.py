"""Sharding by a k-d tree over document metadata, in DataFrame operations only.

A node is split along its widest dimension (source, language and length as fractions of the root's extent) at the weighted median,
weighted by bytes, until the wanted number of leaves remains; with an odd number of leaves the cut is at that proportion. Equal texts are one
group, placed by the least metadata among them. Ties in a dimension are ordered by hashes of the text, then of the id, then of the row,
so that one source, one group of copies or one repeated row that holds most bytes is cut where the bytes say. A cut goes
between groups, at the nearer edge, and through one only if it weighs more than ``GROUP`` of a leaf.

A position has digits: the dimension, two of the text's hash, two of the id's hash and the row. One pass over the table makes
histograms of the first digit for all nodes and dimensions of a level; the bin that holds a cut is refined by the next digit, its
rows alone. Histograms never reach the driver; the states and cuts of a level do while its nodes are at most ``SMALL``, and rows look them
up in literals; beyond, they are written tables that rows join. The slim table of rows with their nodes is written after each level.

Law ``bytes``: sizes near equal. Null texts weigh 16; null metadata is a value of its own; columns of any name may be kept; an empty table
gives no rows. A text of any length is one row's weight, so a shard may exceed the others by what one text weighs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

SHARDS = 40
#: Bits of a dimension, of the text's hash beside it, and of ``tie``; digits as (of ``tie``, bits below the digit, bits of it).
_DIGIT, _TEXT, _TIE = 15, 45, 60
_PARTS = ((False, _TEXT, _DIGIT), (False, 30, 15), (False, 0, 30), (True, 40, 20), (True, 0, 40))
#: Most nodes of a level whose cuts are literals on the plan.
SMALL = 4096
#: A bin below this share of a leaf's bytes is not refined; a group of equal texts is divided only above that one.
FINE, GROUP = 1 / 2000, 1 / 50
#: Rows of a range of slots.
RANGE_ROWS = 50_000
NAMES = ("source", "lang", "length")


def _unit(value: Column) -> Column:
    """A value as an integer of one digit, by hash; null is a value."""
    return F.shiftrightunsigned(F.crc32(F.coalesce(value.cast("string"), F.lit("\0"))), 32 - _DIGIT)


def positions(rows: DataFrame, dimensions: dict[str, Column], text_hash: Column, row: Column) -> DataFrame:
    """Adds ``at_<name>`` for each dimension - its digit and 45 bits of the text's hash - and ``tie``: the row's."""
    text = F.shiftrightunsigned(text_hash, 64 - _TEXT)
    return rows.withColumns({**{f"at_{k}": F.shiftleft(v.cast("long"), _TEXT).bitwiseOR(text) for k, v in dimensions.items()}, "tie": row})


def _tie() -> Column:
    """60 bits: 40 of the id's hash, then 20 that tell repeated rows of an id apart."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64("doc_id"), 24), 20).bitwiseOR(F.shiftrightunsigned(F.xxhash64("row"), 44))


def _digit(column, i: int) -> Column:
    _, shift, width = _PARTS[i]
    return F.shiftright(column, shift).bitwiseAND(F.lit((1 << width) - 1))


def _pinned(df: DataFrame, label: str, rows: int) -> DataFrame:
    """The same rows without lineage: literals if there are few, else a written table."""
    if rows > SMALL:
        return materialize(df, label)
    held = "[" + ",".join(df.toJSON().collect()) + "]"
    shape = F.from_json(F.lit(held), f"array<{df.schema.simpleString()}>")
    return df.sparkSession.range(1).select(F.inline(shape))


def _told(rows: DataFrame, by_node: DataFrame, depth: int, nodes: int) -> DataFrame:
    """Adds ``told``: the other columns of ``by_node`` for the row's node, or null. Nodes of a level are numbered from 2^depth."""
    if nodes > SMALL:
        return rows.join(by_node.select("node", F.struct(*[c for c in by_node.columns if c != "node"]).alias("told")), "node", "left")
    known = {r["node"]: r["j"] for r in by_node.select("node", F.to_json(F.struct(*[c for c in by_node.columns if c != "node"])).alias("j")).collect()}
    held = "[" + ",".join(known.get(n, "null") for n in range(1 << depth, 2 << depth)) + "]"
    shape = by_node.drop("node").schema.simpleString()
    return rows.withColumn("told", F.get(F.from_json(F.lit(held), f"array<{shape}>"), (F.col("node") - (1 << depth)).cast("int")))


def _chosen(names) -> Column:
    return F.element_at(F.array(*[F.col(f"at_{n}") for n in names]), F.col("dim") + 1)


def _crossing(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Of (keys..., goal, bin, w) the bin that holds each group's goal, with the weight before it: ``bin``, ``w``, ``before``."""
    order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = bins.withColumn("upto", F.sum("w").over(order))
    hit = F.min(F.when(F.col("upto") > F.col("goal"), F.struct("bin", "w", (F.col("upto") - F.col("w")).alias("before"))))
    past = F.struct((F.max("bin") + 1).alias("bin"), F.lit(0).cast("long").alias("w"), F.max("upto").alias("before"))
    return summed.groupBy(*keys, "goal").agg(F.coalesce(hit, past).alias("c")).select(*keys, "goal", "c.*")


def cuts(rows: DataFrame, names, extents: list[int], leaf: float, depth: int, nodes: int) -> DataFrame:
    """(node, leaves, base, dim, cut_at, cut_tie): a cut for every node of ``rows`` with more than one leaf, of which there are at most ``nodes``. ``extents``: the root's."""
    open_ = rows.where("leaves > 1")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), _digit(f"at_{n}", 0).alias("bin")) for i, n in enumerate(names)])).alias("x")
    keys = ["node", "leaves", "base"]
    bins = open_.select(*keys, "size", each).select(*keys, "size", "x.*").groupBy(*keys, "dim", "bin").agg(F.sum("size").alias("w"))
    spans = bins.groupBy(*keys, "dim").agg((F.max("bin") - F.min("bin")).alias("span"), F.sum("w").alias("weight"))
    share = F.col("span") / F.element_at(F.array(*[F.lit(max(1, x)) for x in extents]), F.col("dim") + 1)
    wide = spans.groupBy(*keys).agg(F.max(F.struct(share.alias("share"), (-F.col("dim")).alias("less"))).alias("m"), F.max("weight").alias("weight"))
    goal = (F.col("weight") * F.expr("leaves div 2") / F.col("leaves")).alias("goal")
    wide = wide.select(*keys, (-F.col("m.less")).alias("dim"), goal)
    state = _crossing(bins.join(wide, [*keys, "dim"]), [*keys, "dim"])
    state = state.select(*keys, "dim", F.col("bin").alias("at"), F.lit(0).cast("long").alias("tie_at"), "w", (F.col("goal") - F.col("before")).alias("goal"))
    done = None
    for i, (in_tie, shift, _) in enumerate(_PARTS):
        last = i + 1 == len(_PARTS)
        state = _pinned(state, "cuts", nodes)
        # with the text's last digit a bin is one group of equal texts
        least = leaf * (GROUP if i == 2 else FINE)
        stop = F.lit(True) if last else (F.col("w") <= least) | (F.col("goal") <= 0)
        here = F.when((F.col("w") > 0) & (F.col("goal") * 2 > F.col("w")), 1).otherwise(0)
        at = F.col("at") if in_tie else F.shiftleft(F.col("at") + here, shift)
        tie = F.shiftleft(F.col("tie_at") + here, shift) if in_tie else F.lit(0).cast("long")
        settled = state.where(stop).select(*keys, "dim", at.alias("cut_at"), tie.alias("cut_tie"))
        done = settled if done is None else done.unionByName(settled)
        rest = state.where(~stop)
        if last or not rest.limit(1).count():
            break
        inside = _told(open_, rest.select("node", "dim", "at", "tie_at", "goal"), depth, nodes).where("told is not null").select(*open_.columns, "told.*")
        same = (F.shiftright(_chosen(names), shift) == F.col("at")) if not in_tie else (_chosen(names) == F.col("at")) & (F.shiftright("tie", shift) == F.col("tie_at"))
        into, _, width = _PARTS[i + 1]
        finer = inside.where(same).groupBy(*keys, "dim", "at", "tie_at", "goal", _digit("tie" if into else _chosen(names), i + 1).alias("bin")).agg(F.sum("size").alias("w"))
        crossed = _crossing(finer, [*keys, "dim", "at", "tie_at"])
        at = F.col("at") if into else F.shiftleft("at", width) + F.col("bin")
        tie = F.shiftleft("tie_at", width) + F.col("bin") if into else F.col("tie_at")
        state = crossed.select(*keys, "dim", at.alias("at"), tie.alias("tie_at"), "w", (F.col("goal") - F.col("before")).alias("goal"))
    return _pinned(done, "level", nodes)


def _step(rows: DataFrame, level: DataFrame, names, depth: int, nodes: int) -> DataFrame:
    """Rows with the nodes of the next level."""
    told = _told(rows, level.select("node", "dim", "cut_at", "cut_tie"), depth, nodes).select(*rows.columns, "told.*")
    at = _chosen(names)
    low = (at < F.col("cut_at")) | ((at == F.col("cut_at")) & (F.col("tie") < F.col("cut_tie")))
    left = F.expr("leaves div 2")
    parted = F.col("dim").isNotNull()
    return told.withColumns({
        "node": F.when(parted, F.col("node") * 2 + F.when(low, 0).otherwise(1)).otherwise(F.col("node")),
        "base": F.when(parted & ~low, F.col("base") + left).otherwise(F.col("base")),
        "leaves": F.when(parted & low, left).when(parted, F.col("leaves") - left).otherwise(F.col("leaves")),
    }).drop("dim", "cut_at", "cut_tie")


def leaved(slim: DataFrame, names, leaves: int) -> DataFrame:
    """Adds ``shard`` to rows of (size, at_<name>..., tie): the leaf of the tree with so many leaves."""
    digits = [_digit(f"at_{n}", 0) for n in names]
    total, *extents = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), *[F.coalesce(F.max(d) - F.min(d), F.lit(0)) for d in digits]).first()
    rows = slim.withColumns({"node": F.lit(1).cast("long"), "leaves": F.lit(leaves).cast("long"), "base": F.lit(0).cast("long")})
    if total:
        for depth in range((leaves - 1).bit_length()):
            nodes = min(leaves, 1 << depth)
            rows = materialize(_step(rows, cuts(rows, names, extents, total / leaves, depth, nodes), names, depth, nodes), "nodes")
    return rows.withColumn("shard", F.col("base").cast("int")).drop("node", "leaves", "base")


def assign(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (and ``keep``) for rows of (doc_id, text, lang, source): ``shards`` leaves, or as many as ``target_bytes`` asks for."""
    text = F.coalesce("text", F.lit(""))
    depth = F.least(F.floor(F.log2(F.octet_length(text) + 1) * 1024), F.lit((1 << _DIGIT) - 1)).cast("long")
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept") if keep else F.lit(None).cast("int").alias("kept")
    bare = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), _unit(F.col("source")).alias("source"), _unit(F.col("lang")).alias("lang"), depth.alias("length"), kept)
    bare = materialize(bare.withColumn("row", F.monotonically_increasing_id()), "sized")
    # equal texts have one place; only repeated texts are joined, Spark weighing the smaller side
    same = ["h", "text_crc32", "size"]
    groups = bare.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("source", "lang")).alias("m")).where("n > 1").select(*same, "m")
    grouped = bare.join(groups, same, "left").withColumns({"source": F.coalesce("m.source", "source"), "lang": F.coalesce("m.lang", "lang")})
    placed = positions(grouped, {n: F.col(n) for n in NAMES}, F.col("h"), _tie())
    slim = materialize(placed.select("doc_id", "size", "text_crc32", "kept", "tie", *[f"at_{n}" for n in NAMES]), "placed")
    rows, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    out = slotted(leaved(slim, NAMES, shards), max(1, rows // (shards * RANGE_ROWS)))
    return out.select("doc_id", "size", "text_crc32", "shard", "slot", *[F.col(f"kept.`{c}`").alias(c) for c in keep or []])


def slotted(rows: DataFrame, ranges: int) -> DataFrame:
    """Adds ``slot``: gapless from 0 in each shard, in so many ranges of a hash of the row, so that no task holds a large shard."""
    ranged = rows.withColumn("range", F.pmod(F.xxhash64("tie"), F.lit(ranges)).cast("int"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n")).select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("shard", "range").orderBy("tie", "text_crc32", "size")) - 1
    return ranged.withColumn("inner", inner).join(bases, ["shard", "range"]).withColumn("slot", F.col("start") + F.col("inner")).drop("range", "start", "inner")


def op2_kd_shards(spark, sf_dir: str) -> DataFrame:
    rows = assign(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
