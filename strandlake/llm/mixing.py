"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Slots j = 0, 1, ... take the points of a golden-ratio sequence (an odd multiple of j modulo 2^31), which fall into the sources'
cumulative shares. A source's r-th slot takes the r-th block of its documents, shuffled by a hash of the id and cut into blocks of
equal words; after its last block a source starts again, at most ``most`` times over. The count of slots of a source differs from its
share by a few at most, at every prefix of the schedule, so readers of any prefix see the target weights.

The order of a source's documents is that of a hash of id and text, summed in ranges of about ``RANGE_ROWS`` rows each, so that neither a hot
source nor rows without ids, or of one id, gather in a task; rows that agree in both are next to each other and of one size.

Targets: weights by rank of the source (code points, null last) share ``share`` of all words; none exceeds ``most`` times its
source's words, and what is cut goes to the others by weight. Nothing but one row of totals reaches the driver. Null texts have
no words and are never taken; repeated rows are documents of their own; an empty table gives no rows. Texts of any length are
counted whole, and cut into blocks like others. Columns that are kept may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

#: Odd and near 2^31 times the golden ratio's fraction.
GOLDEN, CIRCLE = 1_327_217_885, 1 << 31
WEIGHTS = (5, 2, 1)
MOST = 3
#: Words of a block at most; slots of a source on average at least.
BLOCK_WORDS, SLOTS = 1024, 4096
#: Rows of a range of a source's documents, on average.
RANGE_ROWS = 500
_BINS = 4096
_CHUNK = 1 << 16


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """(source_no, source, source_size, target) from (source, source_size): one row a source."""
    by = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.select("source", "source_size", F.row_number().over(by).alias("source_no"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("source_no") - 1, F.lit(len(weights))).cast("int") + 1)
    ranked = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    # the level at which caps and shares meet: the first source, by cap over weight, that the level of the rest does not cap
    upto = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / F.sum("weight").over(onward)
    found = ranked.withColumn("level", level.cast("double")).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    lowest = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "source_no", "level"))).over(everything)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(lowest * F.col("weight"), F.col("cap").cast("double")))
    return found.withColumn("target", target).select("source_no", "source", "source_size", "target")


def schedule(sources: DataFrame, words: int, block: int) -> DataFrame:
    """(slot, source_no, rank): which source each slot takes from, and how many slots it had before (from 0).

    ``sources`` as ``targets`` gives them; ``words`` is the sum of their targets, ``block`` the words of a slot."""
    spark = sources.sparkSession
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    high = F.round(F.sum("target").over(upto) / F.sum("target").over(Window.partitionBy()) * CIRCLE).cast("long")
    edges = sources.withColumn("high", high).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("source_no")), F.lit(0))).where("high > low")
    step = CIRCLE // _BINS
    arcs = edges.select("source_no", "low", "high", F.explode(F.sequence(F.expr(f"low div {step}"), F.expr(f"(high - 1) div {step}"))).alias("bin"))
    points = spark.range(max(1, -(-words // block)) if words else 0).select(F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(CIRCLE)) * GOLDEN, F.lit(CIRCLE)).alias("u"))
    points = points.withColumn("bin", F.expr(f"u div {step}"))
    landed = points.join(arcs, (points.bin == arcs.bin) & (points.u >= arcs.low) & (points.u < arcs.high)).select("slot", "source_no")
    landed = landed.withColumn("chunk", F.expr(f"slot div {_CHUNK}"))
    before = landed.groupBy("source_no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = landed.withColumn("r", F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1)
    return ranked.join(before, ["source_no", "chunk"]).select("slot", "source_no", (F.col("base") + F.col("r")).alias("rank"))


def shuffled(docs: DataFrame) -> DataFrame:
    """Adds ``offset``: the words of the documents before it in its source's order, by ``h`` (60 bits). A source is summed in 2^``bits`` ranges of it."""
    keyed = docs.withColumn("range", F.expr("shiftright(h, 60 - bits)"))
    sums = keyed.groupBy("source_no", "range").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("source_no", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return keyed.withColumn("inner", inner).join(sums, ["source_no", "range"]).withColumn("offset", F.col("base") + F.col("inner")).drop("h", "range", "inner", "base", "bits")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, share: float = 1.0, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken - and the columns in ``keep`` - for each row of (doc_id, source, text)."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    extra = [c for c in keep or [] if c not in ("doc_id", "source")]
    h = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))), 1, 15), 16, 10).cast("long")
    slim = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), h.alias("h"), *[F.col(c).alias(f"kept_{c}") for c in extra]), "sizes")
    sources = materialize(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, share), "targets")
    n, total, wanted = slim.agg(F.countDistinct("source"), F.coalesce(F.sum("size"), F.lit(0))).join(sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("w")), F.lit(True)).first()
    block = max(1, min(BLOCK_WORDS, total // (SLOTS * (n + 1))))
    counts = slim.groupBy(F.col("source").alias("name")).agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / F.lit(RANGE_ROWS)))).cast("int").alias("bits"))
    sized = materialize(sources.join(counts, sources.source.eqNullSafe(counts.name)).drop("name"), "ranges")
    numbered = slim.join(sized, slim.source.eqNullSafe(sized.source)).drop(sized.source)
    placed = shuffled(numbered)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block).cast("long"))
    taken = schedule(sources, round(wanted), block).join(sources.select("source_no", blocks.alias("blocks")), "source_no")
    taken = taken.where(F.expr("rank div blocks") < most).groupBy("source_no", F.expr("rank % blocks").alias("block")).agg(F.count(F.lit(1)).alias("times"))
    spread = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"offset div {block}"), F.expr(f"(offset + size - 1) div {block}"))))
    overlap = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("offset"), F.col("block") * block)
    names = [f"kept_{c}" for c in extra]
    keys = ["doc_id", "source", "size", "source_size", "target", *names]
    got = spread.withColumn("words", overlap).join(taken, ["source_no", "block"], "left").groupBy("source_no", "offset", *keys).agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    empty = placed.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    out = got.select(*keys, "taken").unionByName(empty)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", *[F.col(f"kept_{c}").alias(c) for c in extra])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = f"""
with d as (select doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as source_no from d group by source),
w as (select *, [5, 2, 1][((source_no - 1) % 3 + 1)::int] as weight, source_size * 3 as cap from s),
l as (select *, ((sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / weight, source_no rows between unbounded preceding and 1 preceding), 0)::double)
  / (sum(weight) over (order by cap / weight, source_no rows between current row and unbounded following))::double as level from w),
v as (select arg_min(level, (cap / weight, source_no)) as level from l where level <= cap / weight),
t as (select source_no, source, source_size, least(cap::double, weight * v.level) as target from l, v),
c as (select greatest(1, least(1024, sum(source_size) // (4096 * (count(source) + 1))))::bigint as b, round(sum(target))::bigint as words from t),
e as (select source_no, round(sum(target) over (order by source_no) / sum(target) over () * 2147483648)::bigint as high from t),
a as (select source_no, coalesce(lag(high) over (order by source_no), 0) as low, high from e),
p as (select j as slot, (j * 1327217885) % 2147483648 as u from c, unnest(range((words + b - 1) // b)) as g(j)),
r as (select slot, source_no, row_number() over (partition by source_no order by slot) - 1 as rank from p join a on u >= low and u < high),
k as (select r.source_no, rank % greatest(1, (source_size + b - 1) // b) as block, count(*) as times from r join t using (source_no), c
  where rank // greatest(1, (source_size + b - 1) // b) < 3 group by all),
o as (select d.doc_id, d.size, t.source_no, t.source_size, t.target, (sum(d.size) over (partition by t.source_no order by substr(md5(coalesce(d.doc_id::varchar, '') || ':' || coalesce(d.text, '')), 1, 15), d.doc_id, d.size
  rows unbounded preceding) - d.size)::bigint as pos from d join t on d.source is not distinct from t.source),
x as (select o.*, unnest(case when size > 0 then range(pos // b, (pos + size - 1) // b + 1) else [0] end) as block, b from o, c)
select doc_id, size, source_size, target, sum(case when size > 0 then (least(pos + size, (block + 1) * b) - greatest(pos, block * b)) * coalesce(times, 0) else 0 end)::bigint as taken
from x left join k using (source_no, block) group by source_no, pos, doc_id, size, source_size, target
"""
