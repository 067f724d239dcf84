"""FASTA and FASTQ files as DataFrames of reads, and back.

Files are read by Spark's own text source, so every file system, gzip and byte-range split works. A FASTA file is split before each
``>`` at the start of a line. FASTQ records are groups of four lines; since ``@`` may begin a quality line, lines are numbered: each
split counts its lines, sums over the splits of a file give offsets, and records are put together by number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import reads as R
from ..operators.filters import validate
from ..schema import FASTA, FASTQ_ASCII, FASTQ_NUMERIC, READ_SCHEMA


def _lines(spark: SparkSession, path, separator: str = "\n", counted=None) -> DataFrame:
    """(value, file, no, before): text pieces with their 0-based number in the file, and how many records earlier files hold.

    ``counted(last, pieces, value)`` says so for one file: of the number of its last non-blank piece, the count of pieces and the first piece."""
    raw = spark.read.option("lineSep", separator).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    full = F.max(F.when(F.regexp_like("value", F.lit("[^\r\n]")), F.col("id")))
    blocks = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), full.alias("full"), F.min_by(F.substring("value", 1, 2), "id").alias("head"))
    own = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("base", F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.coalesce(F.max(F.col("base") + F.col("full") - F.col("first")), F.lit(-1))
    per = blocks.groupBy("file").agg(last.alias("last"), F.sum("n").alias("pieces"), F.min_by("head", "block").alias("head"))
    records = counted(F.col("last"), F.col("pieces"), F.col("head")) if counted else F.col("pieces")
    per = per.withColumn("records", records.cast("long"))
    per = per.select("file", F.coalesce(F.sum("records").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    joined = raw.join(blocks.select("file", "block", "first", "base").join(per, "file"), ["file", "block"])
    return joined.select("value", "file", (F.col("base") + F.col("id") - F.col("first")).alias("no"), "before")


def _chomp(c):
    """The first line of a text, cut at its first CR."""
    return F.regexp_replace(c, "[\r\n][\\s\\S]*$", "")


def _not_empty(df: DataFrame, empty: str) -> DataFrame:
    if empty not in ("ok", "error"):
        raise ValueError("empty is ok or error")
    if empty == "error" and not df.limit(1).count():
        raise ValueError("premature end of input: no records")
    return df


def read_fasta(spark: SparkSession, path, multi_line: bool = False, mode: str = "FAILFAST", allow_u: bool = False, lower: bool = False, check: bool = True, empty: str = "ok") -> DataFrame:
    """Single-line FASTA, alphabet-checked; with ``multi_line`` wrapped FASTA, any letters, as the formatter reads it: blank lines go, and
    so do lines before the first ``>`` (unless there is none: then they are one read without a name). Lines end at their first CR.

    ``ord`` counts the records of all files, in the order of their paths, from 0. ``empty="error"`` refuses an input without records."""

    def counted(last, pieces, head):
        blank = F.when(last < 0, 1)
        stray = F.when(~head.startswith(">"), F.lit(0 if not multi_line else 1))
        return F.when(blank == 1, 0).when(pieces > 1, pieces - F.coalesce(stray, F.lit(0))).otherwise(pieces)

    pieces = _lines(spark, path, "\n>", counted)
    body = F.when(F.col("no") == 0, F.regexp_replace("value", "^>", "")).otherwise(F.col("value"))
    stray = (F.col("no") == 0) & ~F.col("value").startswith(">")
    parts = pieces.withColumn("body", body).withColumn("stray", stray)
    name = F.when(F.col("stray"), "").otherwise(_chomp("body"))
    rest = F.when(F.col("stray"), F.col("body")).otherwise(F.regexp_replace("body", "^[^\n]*\n?", ""))
    reads = parts.select((F.col("before") + F.col("no")).alias("ord"), name.alias("name"), rest.alias("rest"), "stray", "file", "no")
    if multi_line:
        # lines before the first id count only in a file without ids
        by = Window.partitionBy("file")
        lone = reads.where("stray").select("file").distinct()
        if lone.limit(1).count():
            reads = reads.withColumns({"last": F.max("no").over(by), "strays": F.max("stray").over(by)}).where(~F.col("stray") | (F.col("last") == 0))
            reads = reads.withColumn("ord", F.col("ord") - F.when(F.col("strays") & (F.col("last") > 0), 1).otherwise(0))
        seq = F.regexp_replace("rest", "\\s", "")
    else:
        split = F.transform(F.split("rest", "\n"), _chomp)
        seq = F.when(F.size(F.filter(split, lambda s: s != "")) > 1, F.raise_error(F.concat(F.lit("multi-line FASTA at record "), F.col("ord").cast("string"))).cast("string")).otherwise(F.get(split, F.lit(0))) if mode == "FAILFAST" else F.get(split, F.lit(0))
    out = reads.where((F.col("name") != "") | (F.trim("rest") != "")).select("ord", "name", seq.alias("seq"), F.lit(None).cast("string").alias("name2"), F.lit(None).cast("array<int>").alias("qual"), F.lit(FASTA).alias("fmt"))
    return _not_empty(out if multi_line or not check else out.transform(validate(mode, True, allow_u, lower)), empty)


def read_fastq(spark: SparkSession, path, offset: int = 33, encoding: str = "auto", mode: str = "FAILFAST", lower: bool = False, check: bool = True, strict: bool = False, empty: str = "ok") -> DataFrame:
    """Four-line FASTQ. A quality line as long as the sequence is ASCII, any other numeric, unless ``encoding`` says ``ascii`` or ``numeric``.

    Lines end at their first CR; blank lines after the last record are no record. ``ord`` counts the records of all files, in the order of
    their paths, from 0. ``strict`` also wants a third line that begins with ``+`` and repeats the name or nothing; ``empty="error"``
    refuses an input without records."""
    lines = _lines(spark, path, "\n", lambda last, pieces, head: F.expr("last div 4") + F.when(last < 0, 0).otherwise(1))
    lines = lines.withColumn("value", _chomp("value")).where("value <> '' or no % 4 <> 0")
    field = lambda i: F.max(F.when(F.col("no") % 4 == i, F.col("value"))).alias(f"l{i}")
    records = lines.groupBy("file", "before", F.expr("no div 4").alias("rec")).agg(*[field(i) for i in range(4)]).where("l0 is not null or coalesce(l1, '') <> '' or coalesce(l2, '') <> '' or coalesce(l3, '') <> ''")
    is_ascii = {"auto": F.length("l3") == F.length("l1"), "ascii": F.lit(True), "numeric": F.lit(False)}[encoding]
    qual = F.when(F.col("l3").isNull(), F.array().cast("array<int>")).when(is_ascii, R.decode_ascii("l3", offset)).otherwise(F.transform(F.split(F.trim("l3"), "\\s+"), lambda x: x.try_cast("int")))
    name = F.when(F.col("l0").startswith("@"), F.substring("l0", 2, 1 << 30))
    name2 = F.coalesce(F.substring("l2", 2, 1 << 30), F.lit(""))
    if strict:
        wrong = ~F.coalesce(F.col("l2").startswith("+"), F.lit(False)) | ((name2 != "") & (name2 != name))
        name2 = F.when(wrong, F.raise_error(F.concat(F.lit("third line of record "), (F.expr("before") + F.col("rec")).cast("string"))).cast("string")).otherwise(name2)
    reads = records.select((F.col("before") + F.col("rec")).alias("ord"), name.alias("name"), F.col("l1").alias("seq"), name2.alias("name2"), qual.alias("qual"), F.when(is_ascii, FASTQ_ASCII).otherwise(FASTQ_NUMERIC).alias("fmt"))
    return _not_empty(reads.transform(validate(mode, True, False, lower)) if check else reads, empty)


def read_reads(spark: SparkSession, path, **options) -> DataFrame:
    """Either kind, by the first character of each file; ``ord`` counts FASTA files before FASTQ files. Empty files hold no reads."""
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    # a row a file, as many as the driver lists in any case
    firsts = raw.where("value rlike '[^\\\\r]'").groupBy("file").agg(F.min_by(F.substring("value", 1, 1), F.struct("block", "id")).alias("c")).orderBy("file").collect()
    paths = {c: [r["file"] for r in firsts if r["c"] == c] for c in ">@"}
    if odd := [r["file"] for r in firsts if r["c"] not in ">@"]:
        raise ValueError(f"neither FASTA nor FASTQ: {odd[0]}")
    own = {k: v for k, v in options.items() if k not in ("offset", "encoding", "strict")}
    frames = [f(spark, paths[c], **o) for c, f, o in ((">", read_fasta, own), ("@", read_fastq, options)) if paths[c]]
    if not frames:
        return _not_empty(spark.createDataFrame([], READ_SCHEMA), options.get("empty", "ok"))
    return frames[0] if len(frames) == 1 else union(*frames)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): lines of a tab-separated file in order."""
    return _lines(spark, path).select((F.col("before") + F.col("no")).alias("ord"), "value")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A statistics report; reads passed by mistake are refused."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=True)
    if df.columns[:3] not in (["column", "count", "min"], ["cycle", "max_count", "ALL_count"]):
        raise ValueError("not a statistics report: " + ", ".join(df.columns[:3]))
    return df


def record_text(fmt: str | None = None, offset: int = 33):
    """A read as text: ``fmt``, or each read as it came."""
    kind = F.lit(fmt) if fmt else F.col("fmt")
    fasta = F.concat(F.lit(">"), "name", F.when(F.col("seq") == "", "").otherwise(F.concat(F.lit("\n"), "seq")))
    if fmt == FASTA:
        return fasta
    short = F.slice("qual", F.lit(1), F.length("seq"))
    quality = F.when(kind == FASTQ_NUMERIC, R.encode_numeric(short)).otherwise(R.encode_ascii(short, offset))
    lacking = F.raise_error(F.lit("FASTQ output needs qualities")).cast("string")
    fastq = F.when(F.col("qual").isNull(), lacking).otherwise(F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+"), F.coalesce("name2", F.lit("")), F.lit("\n"), quality))
    return F.when(kind == FASTA, fasta).otherwise(fastq)


def write_reads(df: DataFrame, path: str, fmt: str | None = None, offset: int = 33, gzip: bool = False, ordered: bool = True, mode: str = "error") -> None:
    """Part files of records; in ``ord`` order across them if ``ordered``."""
    rows = df.orderBy("ord") if ordered else df
    rows.select(record_text(fmt, offset).alias("value")).write.mode(mode).option("compression", "gzip" if gzip else "none").text(path)


def write_lines(df: DataFrame, path: str, column: str = "line", gzip: bool = False, mode: str = "error") -> None:
    """Tabulated reads, or other lines, in ``ord`` order."""
    df.orderBy("ord").select(F.col(column).alias("value")).write.mode(mode).option("compression", "gzip" if gzip else "none").text(path)


def write_demultiplexed(assigned: DataFrame, path: str, barcodes, fmt: str | None = None, offset: int = 33, mode: str = "error", prefix: str = "", suffix: str = "", gzip: bool = False) -> None:
    """A folder ``<prefix><ident><suffix>`` of part files for each ident and ``unmatched``, as the report's locations say; those without reads
    get an empty one. The input is evaluated once."""
    spark = assigned.sparkSession
    rows = assigned.select("barcode", record_text(fmt, offset).alias("value"))
    rows.write.mode(mode).partitionBy("barcode").option("compression", "gzip" if gzip else "none").text(path)
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for ident in sorted({i for i, _ in barcodes} | {"unmatched"}):
        made, named = jvm.Path(f"{path}/barcode={ident}"), jvm.Path(f"{path}/{prefix}{ident}{suffix}")
        if files.exists(made):
            files.rename(made, named)
        else:
            spark.createDataFrame([], "value string").coalesce(1).write.mode("append").text(f"{path}/{prefix}{ident}{suffix}")


#: What the tools print for a nucleotide that a cycle lacks (fixed values).
ABSENT = {"count": "0", "min": "100", "max": "-100", "sum": "0", "mean": "-nan", "Q1": "100", "med": "100", "Q3": "100", "IQR": "0", "lW": "100", "rW": "-100"}


def report_lines(report: DataFrame, compat: bool = False) -> list[str]:
    """A statistics report as TSV lines: means with two decimals, absent values empty or, with ``compat``, as the tools print them. A row for each cycle."""
    first = report.columns[0]
    rows = report.orderBy(first).collect()

    def shown(column, v):
        if v is None:
            return ABSENT.get(column.rsplit("_", 1)[-1], "") if compat else ""
        return f"{v:.2f}" if isinstance(v, float) else str(v)

    return ["\t".join(report.columns), *("\t".join(map(shown, report.columns, r)) for r in rows)]


def write_report(report: DataFrame, path: str, mode: str = "error", compat: bool = False) -> None:
    write_text(report.sparkSession, report_lines(report, compat), path, mode)


def write_text(spark: SparkSession, lines: list[str], path: str, mode: str = "error") -> None:
    """A report of a few lines (statistics, or ``metrics.*_lines``) as one part file."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode(mode).text(path)


def html_table(rows: DataFrame, link: str | None = None) -> str:
    """A small summary as an HTML table; the ``link`` column becomes anchors."""
    from html import escape

    cell = lambda k, v: f'<a href="{escape(str(v))}">{escape(str(v))}</a>' if k == link and v is not None else escape("" if v is None else str(v))
    head = "<tr>" + "".join(f"<th>{escape(c)}</th>" for c in rows.columns) + "</tr>"
    body = ["<tr>" + "".join(f"<td>{cell(k, v)}</td>" for k, v in r.asDict().items()) + "</tr>" for r in rows.collect()]
    return "<table>\n" + "\n".join([head, *body]) + "\n</table>"


def union(*frames: DataFrame) -> DataFrame:
    """Reads of several inputs, one after the other, with ``ord`` renumbered by input."""
    shifted = [f.withColumn("ord", F.col("ord") + F.lit(i) * (1 << 44)) for i, f in enumerate(frames)]
    return reduce(DataFrame.unionByName, shifted)
