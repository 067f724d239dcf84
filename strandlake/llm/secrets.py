"""Secret scans: three base patterns, and weak parts that are linked when complementary ones meet in a scope.

Everything is a SQL expression. Positions of the n-th match come from the pieces between matches (``split``) and the matches
(``regexp_extract_all``): a running sum over both within a row gives code-point offsets in linear time. Weak parts - identifiers,
opaque strings and endpoints - are reported only if at most ``scope`` code points lie between them and a complementary part that does
not overlap them. That interval join is a window over the starts and ends of all parts of a text, in order: a part looks back from its
start for ends and ahead from its end for starts, so a text with many parts makes no pairs.

Null texts are empty. Every row is scanned on its own, so repeated rows repeat, with ids of any kind or none. A row without matches has
empty spans; an empty table gives no rows. Spans that start together come in the order of the kinds. Columns other than the two named are
not read, so their names cannot clash. Texts of any length are scanned whole, in time linear in their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

# kind, pattern, capture group whose length counts, least length
BASE = [
    ("assign", "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]{16,}", 0, 16),  # the runs of 16 or more are those of [0-9a-f]+ that are kept
]
WEAK = [
    ("weak_id", "\\b(?=[A-Z0-9]*[0-9])[A-Z][A-Z0-9]{15,31}\\b", 0, 16),
    ("weak_secret", "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}+={0,2}+(?![A-Za-z0-9+/=])", 0, 32),
    ("endpoint", "https?://[A-Za-z0-9.-]+(?::[0-9]+)?", 0, 8),
]
#: What each weak kind needs near it.
PARTNERS = {"weak_id": ("weak_secret", "assign"), "weak_secret": ("weak_id", "access"), "endpoint": ("weak_secret", "assign")}
SCOPE = 160


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(kind: str, pattern: str, group: int):
    """Array of (order of the kind, length between, length of the match, length that counts), one for each match."""
    p = _quoted(pattern)
    whole = f"regexp_extract_all(__text, {p}, 0)"
    counted = f"regexp_extract_all(__text, {p}, {group})"
    order = [k for k, *_ in BASE + WEAK].index(kind)
    made = f"transform(arrays_zip(slice(split(__text, {p}, -1), 1, size({whole})), {whole}, {counted}), (x, i) -> named_struct('kind', {order}, 'at', i, 'gap', length(x.`0`), 'n', length(x.`1`), 'part', length(x.`2`)))"
    return F.expr(f"if(__text rlike {p}, {made}, array())")


def find_secrets(docs: DataFrame, scope: int = SCOPE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, spans): an array of (start, order, kind, end) structs, by start and kind; base spans always, weak ones if linked."""
    kinds = BASE + WEAK
    slim = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("__text")).withColumn("row", F.monotonically_increasing_id())
    rows = slim.select("row", "doc_id", F.explode_outer(F.concat(*[_matches(k, p, g) for k, p, g, _ in kinds])).alias("m")).select("row", "doc_id", "m.*")
    run = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    least = F.element_at(F.array(*[F.lit(n) for *_, n in kinds]), F.col("kind") + 1)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(run)).withColumn("start", F.col("end") - F.col("n")).where(F.col("kind").isNull() | (F.col("part") >= least) | (F.col("at") == 0)).withColumn("ok", F.col("part") >= least)
    names = [k for k, *_ in kinds]
    both = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(True).alias("opens")), F.struct(F.col("end").alias("pos"), F.lit(False).alias("opens")))).alias("e")
    events = placed.select("row", "doc_id", "kind", "start", "end", "ok", both).select("row", "doc_id", "kind", "start", "end", "ok", "e.*")
    by = Window.partitionBy("row").orderBy("pos")
    linked = F.lit(False)
    for kind, partners in PARTNERS.items():
        mate = F.col("ok") & F.col("kind").isin([names.index(p) for p in partners])
        behind = F.max(mate & ~F.col("opens")).over(by.rangeBetween(-scope, Window.currentRow))
        ahead = F.max(mate & F.col("opens")).over(by.rangeBetween(Window.currentRow, scope))
        linked = linked | ((F.col("kind") == names.index(kind)) & F.when(F.col("opens"), behind).otherwise(ahead))
    kept = events.withColumn("keep", F.col("ok") & ((F.col("kind") < len(BASE)) | linked))
    span = F.when(F.col("keep"), F.struct("start", F.col("kind").alias("order"), F.element_at(F.array(*map(F.lit, names)), F.col("kind") + 1).alias("kind"), "end"))
    return kept.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_set(span)).alias("spans")).drop("row")


def _joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda i: F.size(F.filter("spans", lambda s: s["order"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
