"""Sources, sinks, streams and the registered queries."""

import glob
import gzip
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlake.operators import barcode, clip, collapse, project, stats
from strandlake.plans import catalogue
from strandlake.sources import files
from strandlake.streaming import reads as streams

FASTQ = "@r1 x\nACGT\n+\nIIII\n@r2\nACG\n+r2\n@+I\n@r3\nAC\n+\n40 -5\n"


def put(path, text):
    if str(path).endswith(".gz"):
        with gzip.open(path, "wt") as f:
            f.write(text)
    else:
        path.write_text(text)
    return str(path)


def lines(df, **k):
    return [x for r in df.orderBy("ord").select(files.record_text(**k).alias("v")).collect() for x in r.v.split("\n")]


def test_fastq_encodings_and_awkward_quality_lines(spark, tmp_path):
    df = files.read_fastq(spark, put(tmp_path / "a.fastq.gz", FASTQ))
    assert [(r.ord, r.name, r.seq, r.name2, r.qual, r.fmt) for r in df.orderBy("ord").collect()] == [
        (0, "r1 x", "ACGT", "", [40] * 4, "fastq_ascii"), (1, "r2", "ACG", "r2", [31, 10, 40], "fastq_ascii"), (2, "r3", "AC", "", [40, -5], "fastq_numeric")]
    assert lines(df) == FASTQ.split("\n")[:-1]
    assert lines(df, fmt="fasta")[:2] == [">r1 x", "ACGT"]


def test_fastq_split_anywhere_keeps_records_and_order(spark, tmp_path):
    text = "".join(f"@read{i}\n{'ACGT' * (1 + i % 9)}\n+\n{'@+I5' * (1 + i % 9)}\n" for i in range(3000))
    path = put(tmp_path / "big.fastq", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
        df = files.read_fastq(spark, path)
        assert lines(df) == text.split("\n")[:-1]
        assert [r.ord for r in df.orderBy("ord").collect()] == list(range(3000))
        fasta = put(tmp_path / "big.fasta", "".join(f">read{i} >x\n{'ACGT' * (1 + i % 9)}\n" for i in range(3000)))
        assert [r.name for r in files.read_fasta(spark, fasta).orderBy("ord").collect()] == [f"read{i} >x" for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("text,said", [("@a\nACGT\n+\nIII\n", "qualities"), ("r\nAC\n+\nII\n", "id line"), ("@a\nAXGT\n+\nIIII\n", "nucleotide"), ("@a\nAC\n", "qualities"), ("@a\n\n+\n\n", "sequence")])
def test_bad_fastq_fails(spark, tmp_path, text, said):
    with pytest.raises(Exception, match=said):
        files.read_fastq(spark, put(tmp_path / "bad.fastq", text)).collect()


def test_fasta_kinds(spark, tmp_path):
    wrapped = put(tmp_path / "w.fasta", "junk\n>a one\r\nACGT\r\n\nacg\n>empty\n>b\nTT\n")
    got = [(r.name, r.seq) for r in files.read_fasta(spark, wrapped, multi_line=True).orderBy("ord").collect()]
    assert got == [("a one", "ACGTacg"), ("empty", ""), ("b", "TT")]
    bare = put(tmp_path / "bare.fasta", "AC\nGT\n")
    assert [(r.name, r.seq) for r in files.read_fasta(spark, bare, multi_line=True).collect()] == [("", "ACGT")]
    with pytest.raises(Exception, match="multi-line"):
        files.read_fasta(spark, put(tmp_path / "m.fasta", ">a\nAC\nGT\n")).collect()
    with pytest.raises(Exception, match="invalid nucleotide"):
        files.read_fasta(spark, put(tmp_path / "l.fasta", ">a\nacgt\n")).collect()
    assert files.read_fasta(spark, str(tmp_path / "l.fasta"), lower=True).count() == 1
    assert files.read_reads(spark, put(tmp_path / "none.fasta", "")).collect() == []
    assert files.read_reads(spark, put(tmp_path / "x.fastq", FASTQ)).count() == 3
    with pytest.raises(ValueError):
        files.read_reads(spark, put(tmp_path / "odd.txt", "hello\n"))


def test_round_trips_and_sinks(spark, tmp_path):
    df = files.read_fastq(spark, put(tmp_path / "a.fastq", FASTQ.replace("@r3\nAC\n+\n40 -5\n", "")))
    files.write_reads(df, str(tmp_path / "out"), gzip=True)
    assert lines(files.read_fastq(spark, str(tmp_path / "out"))) == lines(df)
    numeric = df.transform(project.convert_quality(True))
    files.write_reads(numeric, str(tmp_path / "num"))
    assert [r.qual for r in files.read_fastq(spark, str(tmp_path / "num")).orderBy("ord").collect()] == [[40] * 4, [31, 10, 40]]
    with pytest.raises(Exception, match="needs qualities"):
        df.transform(project.to_fasta()).select(files.record_text("fastq_ascii")).collect()
    codes = [("B1", "ACGT"), ("B2", "TTTT")]
    files.write_demultiplexed(df.transform(barcode.assign_barcodes(codes, "bol", 0)), str(tmp_path / "demux"), codes)
    assert sorted(x.rsplit("/", 1)[1] for x in glob.glob(f"{tmp_path}/demux/*") if not x.endswith("_SUCCESS")) == ["B1", "B2", "unmatched"]
    files.write_demultiplexed(df.transform(barcode.assign_barcodes(codes, "bol", 0)), str(tmp_path / "named"), codes, prefix="run_", suffix=".txt")
    assert [r.seq for r in files.read_fastq(spark, str(tmp_path / "named" / "run_B1.txt")).collect()] == ["ACGT", "ACG"]
    assert files.read_fastq(spark, str(tmp_path / "named" / "run_B2.txt")).count() == 0
    report = stats.cycle_stats(df)
    files.write_report(report, str(tmp_path / "report"))
    assert files.read_report(spark, str(tmp_path / "report")).count() == 4
    with pytest.raises(ValueError):
        files.read_report(spark, str(tmp_path / "a.fastq"))
    assert "<table>" in files.html_table(barcode.barcode_counts(df.transform(barcode.assign_barcodes(codes)), codes), "Location")
    files.write_lines(df.transform(project.tabulate()), str(tmp_path / "tab"))
    assert [r.value for r in files.read_table(spark, str(tmp_path / "tab")).orderBy("ord").collect()] == ["r1 x\tACGT", "r2\tACG"]
    assert files.union(df, df).count() == 4


def test_many_files_blank_lines_and_carriage_returns(spark, tmp_path):
    home = tmp_path / "many"
    home.mkdir()
    for i in range(5):
        put(home / f"{i}.fastq", f"@r{i}\r\nACGT\r\n+\r\nIIII\r\n" + "\n" * (i % 3))
    put(home / "5.fastq", "")
    put(home / "6.fastq", "@r5 a\rb\nAC\rGT\n+\rx\nII\rJJ\n@r6\nA\n+\nI")
    df = files.read_fastq(spark, str(home))
    assert [(r.ord, r.name, r.seq, r.qual) for r in df.orderBy("ord").collect()] == [(i, f"r{i}", "ACGT", [40] * 4) for i in range(5)] + [(5, "r5 a", "AC", [40, 40]), (6, "r6", "A", [40])]
    wrapped = tmp_path / "wrapped"
    wrapped.mkdir()
    put(wrapped / "a.fasta", "junk\n>a\nAC\nGT\n")
    put(wrapped / "b.fasta", "\n>b\nTT\r\n\n>c\nA\n")
    put(wrapped / "c.fasta", "")
    put(wrapped / "d.fasta", ">d\nGG\n")
    assert [(r.ord, r.name, r.seq) for r in files.read_fasta(spark, str(wrapped), multi_line=True).orderBy("ord").collect()] == [(0, "a", "ACGT"), (1, "b", "TT"), (2, "c", "A"), (3, "d", "GG")]
    mixed = tmp_path / "mixed"
    mixed.mkdir()
    put(mixed / "a.txt", FASTQ)
    put(mixed / "b.txt", ">x\nACGT\r\n>y\nAC\rTT\n")
    put(mixed / "c.txt.gz", "@z\nA\n+\nI\n")
    got = files.read_reads(spark, str(mixed))
    assert [(r.name, r.seq, r.fmt) for r in got.orderBy("ord").collect()] == [("x", "ACGT", "fasta"), ("y", "AC", "fasta"), ("r1 x", "ACGT", "fastq_ascii"), ("r2", "ACG", "fastq_ascii"), ("r3", "AC", "fastq_numeric"), ("z", "A", "fastq_ascii")]
    put(mixed / "d.txt", "hello\n")
    with pytest.raises(ValueError, match="d.txt"):
        files.read_reads(spark, str(mixed))


def test_strict_options(spark, tmp_path):
    loose = put(tmp_path / "loose.fastq", "@a\nAC\n-\nII\n")
    assert files.read_fastq(spark, loose).count() == 1
    for text in ("@a\nAC\n-\nII\n", "@a\nAC\n+b\nII\n"):
        with pytest.raises(Exception, match="third line of record 0"):
            files.read_fastq(spark, put(tmp_path / "l.fastq", text), strict=True).collect()
    assert files.read_fastq(spark, put(tmp_path / "s.fastq", "@a\nAC\n+a\nII\n@b\nAC\n+\nII\n"), strict=True).count() == 2
    nothing = put(tmp_path / "none.fastq", "")
    assert files.read_fastq(spark, nothing).collect() == []
    for read in (files.read_fastq, files.read_fasta, files.read_reads):
        with pytest.raises(ValueError, match="premature end"):
            read(spark, nothing, empty="error")


def test_empty_sequences_and_absent_nucleotides_as_the_tools_print_them(spark, tmp_path):
    bare = files.read_fasta(spark, put(tmp_path / "e.fasta", ">a\n>b\nAC\n"), multi_line=True)
    assert lines(bare) == [">a", ">b", "AC"]
    report = stats.cycle_nuc_wide(files.read_fastq(spark, put(tmp_path / "a.fastq", "@a\nA\n+\nI\n")))
    plain, compat = (dict(zip(*(x.split("\t") for x in files.report_lines(report, c)))) for c in (False, True))
    assert plain["ALL_mean"] == compat["ALL_mean"] == "40.00" and plain["C_min"] == "" and plain["C_count"] == "0"
    assert [compat[f"C_{m}"] for m in stats.MEASURES] == ["0", "100", "-100", "0", "-nan", "100", "100", "100", "0", "100", "-100"]


def test_chains_shaped_like_the_golden_tests(spark, tmp_path):
    """Offset 64, numeric qualities with -0, a 23-base adapter, a 20-column table with collapsed ids."""
    full = "CAATTGGTTAATCCCCCTATATA"
    seqs = ["ACGTACGTACGTACGTACGTACGTACG" + full[:9], "TTGACGATCAAGATCGA" + full[:19], "GATTACA" * 5 + "G", full + "ACGTACGTACGTA"]
    path = put(tmp_path / "c.fastq", "".join(f"@s{i}\n{s}\n+s{i}\n{'h' * len(s)}\n" for i, s in enumerate(seqs)))
    df = files.read_fastq(spark, path, offset=64)
    assert {q for r in df.collect() for q in r.qual} == {40}
    clipped = df.transform(clip.clip(full, min_length=15, keep_n=True, clipped_only=True))
    assert lines(clipped, offset=64) == ["@s0", seqs[0][:27], "+s0", "h" * 27, "@s1", seqs[1][:17], "+s1", "h" * 17]
    numeric = files.read_fastq(spark, put(tmp_path / "n.fastq", "@a\nACGTA\n+\n40 -1 -0 5 12\n"))
    assert lines(numeric.transform(project.reverse_complement())) == ["@a", "TACGT", "+", "12 5 0 -1 40"]
    assert lines(numeric.transform(project.convert_quality(False)), offset=64)[3] == "h?@EL"
    masked = numeric.transform(project.mask(6, "x"))
    assert lines(masked)[1] == "AxxxA"
    table = ["\t".join([*map(str, range(9)), f"{i + 1}-{n}", *map(str, range(10))]) for i, n in enumerate([5, 2, 1, 1, 7])]
    psl = files.read_table(spark, put(tmp_path / "t.psl", "\n".join(table) + "\n"))
    assert sorted(r.value for r in psl.transform(collapse.uncollapse_tabular(10)).collect()) == sorted(x for x, n in zip(table, [5, 2, 1, 1, 7]) for _ in range(n))
    few = files.read_fasta(spark, put(tmp_path / "f.fasta", ">1-3\n" + "A" * 16 + "\n>2-1\n" + "C" * 35 + "\n"))
    assert lines(few.transform(project.trim_end(2, 16))) == [">2-1", "C" * 33]
    wide = files.read_fasta(spark, put(tmp_path / "w.fasta", ">x y\n" + "ACgt" * 25 + "\n" + "T" * 20 + "\n"), multi_line=True)
    assert lines(wide.transform(project.reformat(60))) == [">x y", ("ACgt" * 25 + "T" * 20)[:60], ("ACgt" * 25 + "T" * 20)[60:]]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "a.fastq", "@a\nACGT\n+\nIIII\n@b\nACNT\n+\nIIII\n@c\nACGT\n+\nIIII\n")
    stream = streams.fastq_rows(spark, str(tmp_path / "in"))
    kept = stream.transform(project.trim(1, 3))
    q = streams.collapse_counts(kept).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.seq, r.cnt) for r in spark.table("counts").collect()) == [("ACG", 2), ("ACN", 1)]
    with pytest.raises(ValueError, match="per_batch"):
        stream.transform(collapse.collapse())
    seen = []
    q = streams.per_batch(stream, collapse.collapse(), lambda df, no: seen.extend((r.name, r.seq) for r in df.orderBy("ord").collect())).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [("1-2", "ACGT"), ("2-1", "ACNT")]


def test_barcode_files_and_windows(spark, tmp_path):
    assert barcode.read_barcodes(spark, put(tmp_path / "codes.txt", "# a comment\n\nBC1\tACGT\nBC2 tttt extra\n")) == [("BC1", "ACGT"), ("BC2", "TTTT")]
    (tmp_path / "win").mkdir()
    put(tmp_path / "win" / "a.fastq", "@a\nACGT\n+\nIIII\n@b\nAC\n+\nII\n@c\nTTTT\n+\nIIII\n")
    timed = streams.fastq_rows(spark, str(tmp_path / "win")).withColumn("time", F.timestamp_seconds(F.col("ord") * 3000))
    q = streams.windowed_counts(timed, "time").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.window.start.hour, r.len, r.n) for r in spark.table("windows").collect()) == [(0, 2, 1), (0, 4, 1), (1, 4, 1)]


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, cur = catalogue.queries()[name](spark, SF), con.sql(catalogue.oracle_sql()[name])
    names = sorted(df.columns)
    assert sorted(cur.columns) == names
    show = lambda v: "" if v is None else repr(round(v, 9)) if isinstance(v, float) and math.isfinite(v) else str(v)
    at = [cur.columns.index(c) for c in names]
    want = sorted(tuple(show(r[i]) for i in at) for r in cur.fetchall())
    assert sorted(tuple(show(r[c]) for c in names) for r in df.collect()) == want and want


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
