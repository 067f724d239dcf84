"""Read operators on small fixtures, with expected rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.functions import reads as R
from strandlake.operators import barcode, charts, clip, collapse, filters, metrics, project, stats
from strandlake.schema import FASTA, FASTQ_ASCII, READ_SCHEMA, OrderedOperatorError


def fq(spark, *rows):
    """Reads of (name, seq, qualities)."""
    return spark.createDataFrame([(i, n, s, n, q, FASTQ_ASCII) for i, (n, s, q) in enumerate(rows)], READ_SCHEMA)


def fa(spark, *rows):
    return spark.createDataFrame([(i, n, s, None, None, FASTA) for i, (n, s) in enumerate(rows)], READ_SCHEMA)


def out(df, *cols):
    return [tuple(r) for r in df.orderBy("ord").select(*(cols or ("name", "seq"))).collect()]


def test_reads_count_rules(spark):
    names = ["cel-let-7 x", "67-3461", "a-5xyz", "1--3", "x-0", "1000", "plain", "a-"]
    rows = fa(spark, *[(n, "A") for n in names]).orderBy("ord").select(R.reads_count(), R.reads_count_tabular("name"), R.reads_count_histogram()).collect()
    assert [r[0] for r in rows] == [1, 3461, 5, 1, 1, 1, 1, 1]
    assert [r[1] for r in rows] == [1, 3461, 1, 1, 1, 1000, 1, 1]
    assert [r[2] for r in rows] == [1, 3461, 1, 1, 0, 1, 1, 1]


def test_reverse_complement_twice_is_the_read(spark):
    df = fq(spark, ("a", "ACGTN", [1, 2, 3, 4, 5]), ("b", "TTG", [7, 8, 9]))
    assert out(df.transform(project.reverse_complement()), "seq", "qual")[0] == ("NACGT", [5, 4, 3, 2, 1])
    assert out(df.transform(project.reverse_complement()).transform(project.reverse_complement()), "seq", "qual") == out(df, "seq", "qual")


def test_mask_trim_and_end_trims(spark):
    df = fq(spark, ("a", "ACGTA", [40, 9, 10, 3, 2]), ("b", "AC", [1, 1]), ("c", "A", [-15]))
    assert [s for _, s in out(df.transform(project.mask(10, "x")))] == ["AxGxx", "xx", "x"]
    assert out(df.transform(project.trim(2, 3)), "seq", "qual") == [("CG", [9, 10]), ("C", [1])]
    assert [s for _, s in out(df.transform(project.trim(2)))] == ["CGTA", "C"]
    assert [s for _, s in out(df.transform(project.trim_end(2, 3)))] == ["ACG"] and [s for _, s in out(df.transform(project.trim_end(1)))] == ["ACGT", "A"]
    assert out(df.transform(project.quality_trim(10)), "seq", "qual") == [("ACG", [40, 9, 10])]
    assert out(df.transform(project.quality_trim(10, 4))) == []
    with pytest.raises(ValueError):
        project.quality_trim(0)
    with pytest.raises(ValueError):
        project.trim(0)


def test_rename_convert_and_nucleotides(spark):
    df = fq(spark, ("a", "ACT", [1, 2, 3]), ("b", "GNT", [1, 2, 3]), ("c", "GGG", [1, 2, 3]))
    assert [n for n, _ in out(df.transform(project.rename("SEQ")))] == ["ACT", "GNT", "GGG"]
    assert out(df.transform(project.rename("COUNT")), "name", "name2") == [("1", "1"), ("2", "2"), ("3", "3")]
    assert out(df.transform(project.to_fasta(rename=True)), "name", "seq", "qual") == [("1", "ACT", None), ("2", "GGG", None)]
    assert len(out(df.transform(project.to_fasta(keep_n=True)))) == 3
    assert [s for _, s in out(df.transform(project.dna_to_rna()))] == ["ACU", "GNU", "GGG"]
    with pytest.raises(Exception, match="already holds"):
        fa(spark, ("a", "AU")).transform(project.dna_to_rna()).collect()
    assert out(df.transform(project.convert_quality(True)), "fmt")[0] == ("fastq_numeric",)


def test_counter_is_dense_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 37 % 5000).alias("ord"))
    got = {r.ord: r.n for r in project.numbered(rows, "n", 16).collect()}
    assert got == {i: i + 1 for i in range(5000)}


def test_quality_filter_equals_the_sorted_rank(spark):
    rng = random.Random(1)
    rows = [(str(i), "A" * n, [rng.randint(-15, 93) for _ in range(n)]) for i, n in enumerate(rng.choices(range(1, 21), k=60))]
    for q, p in ((20, 50), (30, 80), (10, 100), (93, 1), (40, 33)):
        want = [n for n, s, v in rows if sorted(v)[len(v) * (100 - p) // 100] >= q]
        assert [n for n, _ in out(fq(spark, *rows).transform(filters.quality_filter(q, p)))] == want
    assert fq(spark, *rows).transform(filters.quality_filter(90, 0)).count() == 60


def test_artifacts_and_other_filters(spark):
    df = fa(spark, ("a", "AAA"), ("b", "AAAAACGT"), ("c", "AAAACGTC"), ("d", "NNNNNNNN"), ("e", "AAAAAACG"))
    assert [n for n, _ in out(df.transform(filters.artifacts()))] == ["c", "d"]
    assert [n for n, _ in out(df.transform(filters.without_n()).transform(filters.min_length(4)))] == ["b", "c", "e"]


def test_validation_modes(spark):
    df = fq(spark, ("a", "ACGT", [1, 2, 3, 4]), ("b", "ACXT", [1, 2, 3, 4]), ("c", "AC", [1]), ("d", "AC", [1, 94]), ("e", "", []), ("f", "A", [93]))
    assert [p for _, p in out(df.transform(filters.validate("PERMISSIVE")), "name", "problem")] == [None, "invalid nucleotide", "number of qualities differs from length", "quality out of range", "missing sequence", None]
    assert [n for n, _ in out(df.transform(filters.validate("DROPMALFORMED")))] == ["a", "f"]
    with pytest.raises(Exception, match="record [1-4]: "):
        df.transform(filters.validate()).collect()


def test_collapse_and_back(spark):
    df = fa(spark, ("a", "TT"), ("b", "AA"), ("3-4", "CC"), ("d", "TT"), ("e", "AA"))
    once = df.transform(collapse.collapse())
    assert out(once) == [("1-4", "CC"), ("2-2", "AA"), ("3-2", "TT")]
    back = once.transform(collapse.uncollapse(2))
    assert out(back) == [(str(i + 1), s) for i, s in enumerate(["CC"] * 4 + ["AA"] * 2 + ["TT"] * 2)]
    assert out(back.transform(collapse.collapse())) == out(once)
    assert collapse.length_histogram(fa(spark, ("1-0", "AA"), ("2-3", "A"), ("x", "A"))).orderBy("len").collect() == [(1, 4), (2, 0)]


def test_tabular_uncollapse(spark):
    lines = spark.createDataFrame([("x\t3-2\ty",), ("x\t1\ty",), ("x\tq\ty",)], "value string")
    assert sorted(r.value for r in lines.transform(collapse.uncollapse_tabular(2)).collect()) == sorted(["x\t3-2\ty"] * 2 + ["x\t1\ty", "x\tq\ty"])
    with pytest.raises(Exception, match="too few columns"):
        lines.transform(collapse.uncollapse_tabular(4)).collect()


def test_cycle_statistics(spark):
    rng = random.Random(4)
    rows = [(str(i), "".join(rng.choice("ACGTN") for _ in range(n)), [rng.randint(-15, 93) for _ in range(n)]) for i, n in enumerate(rng.choices(range(1, 9), k=41))]
    got = {r["column"]: r for r in stats.cycle_stats(fq(spark, *rows)).collect()}
    for c in range(1, 9):
        v = sorted(q[c - 1] for _, _, q in rows if len(q) >= c)
        n, r = len(v), got[c]
        q1, q3 = v[n // 4], v[n * 3 // 4]
        assert (r["count"], r["min"], r["max"], r["sum"], r["Q1"], r["med"], r["Q3"], r["IQR"]) == (n, v[0], v[-1], sum(v), q1, v[n // 2], q3, q3 - q1)
        assert r["mean"] == pytest.approx(sum(v) / n) and r["lW"] == max(q1 - (q3 - q1) * 3 // 2, v[0]) and r["rW"] == min(q3 + (q3 - q1) * 3 // 2, v[-1])
        assert r["A_Count"] == sum(s[c - 1] == "A" for _, s, _ in rows if len(s) >= c) and r["Max_count"] == 41
    wide = stats.cycle_nuc_wide(fq(spark, *rows)).orderBy("cycle").collect()
    assert len(wide[0]) == 68 and wide[0]["ALL_count"] == 41 and sum(wide[0][f"{b}_count"] for b in "ACGTN") == 41
    plain = stats.cycle_stats(fa(spark, ("1-3", "AC"), ("x", "A"))).orderBy("column").collect()
    assert [(r["count"], r["min"], r["A_Count"], r["Max_count"]) for r in plain] == [(4, None, 4, 4), (3, None, 0, 4)]


CODES = [("BC1", "ACGT"), ("BC2", "ACGA"), ("BC3", "TTTT")]


def test_barcodes(spark):
    df = fa(spark, ("exact", "ACGTCC"), ("tie", "ACGCCC"), ("far", "GGGGGG"), ("short", "AC"), ("three", "TTTAAA"))
    got = out(df.transform(barcode.assign_barcodes(CODES, "bol", 1)), "name", "barcode", "distance")
    assert got == [("exact", "BC1", 0), ("tie", "BC1", 1), ("far", "unmatched", None), ("short", "BC1", 0), ("three", "BC3", 1)]
    assert [b for _, b in out(df.transform(barcode.assign_barcodes(CODES, "bol", 1, exact=True)), "name", "barcode")] == ["BC1", "unmatched", "unmatched", "BC1", "unmatched"]
    tail = fa(spark, ("a", "GGACGA"), ("b", "GGTTTT"))
    assert [b for _, b in out(tail.transform(barcode.assign_barcodes(CODES, "eol", 0)), "name", "barcode")] == ["BC2", "BC3"]
    part = fa(spark, ("a", "CGTGGG"))
    assert out(part.transform(barcode.assign_barcodes(CODES, "bol", 2, partial=1)), "barcode", "distance") == [("BC1", 2)]
    assert out(part.transform(barcode.assign_barcodes(CODES, "bol", 2, partial=1, partial_penalty="doc")), "barcode", "distance") == [("BC1", 1)]
    counts = {r.Barcode: (r.Count, r.Location) for r in barcode.barcode_counts(tail.transform(barcode.assign_barcodes(CODES, "eol", 0)), CODES, "p_", ".t").collect()}
    assert counts == {"BC1": (0, "p_BC1.t"), "BC2": (1, "p_BC2.t"), "BC3": (1, "p_BC3.t"), "unmatched": (0, "p_unmatched.t"), "total": (2, None)}
    assert barcode.parse_barcodes(["# x", "B1\tacg", "B2  TTT"]) == [("B1", "ACG"), ("B2", "TTT")]
    for bad in (["B1 AC", "B2 ACG"], ["B1 AXG"], [], ["B-1 ACG"]):
        with pytest.raises(ValueError):
            barcode.parse_barcodes(bad)


def _align_one(read, adapter):
    """The alignment by its recurrence and a traceback, one cell at a time."""
    f = np.float32
    border = [f(0) if y <= 3 else f(-5 * (y - 3)) for y in range(len(adapter))]
    score, origin, best, where = {}, {}, f(-1e6), None
    for x, q in enumerate(read):
        for y, t in enumerate(adapter):
            pair = f(0) if q == t == "N" else f(0.1) if "N" in (q, t) else f(1) if q == t else f(-1)
            left_of = score[x - 1, y] if x else border[y]
            above = score[x, y - 1] if y else f(0)
            corner = f(0) if y == 0 else score[x - 1, y - 1] if x else border[y - 1]
            options = [(corner + pair, "d"), (above + f(-5), "u"), (f(-100000) if y > 3 and y - 3 > x else left_of + f(-5), "l")]
            score[x, y], origin[x, y] = max(options, key=lambda o: o[0])
            if score[x, y] > best:
                best, where = score[x, y], (x, y)
    x, y = where
    r = dict.fromkeys(("matches", "mismatches", "neutral", "gaps"), 0) | {"query_end": x, "target_end": y}
    while x >= 0 and y >= 0:
        r["query_start"], r["target_start"] = x, y
        o = origin[x, y]
        if o == "d":
            r["neutral" if "N" in (read[x], adapter[y]) else "matches" if read[x] == adapter[y] else "mismatches"] += 1
        else:
            r["gaps"] += 1
        x, y = (x - 1, y - 1) if o == "d" else (x, y - 1) if o == "u" else (x - 1, y)
    return r


def test_alignment_matches_a_scalar_program():
    rng = random.Random(7)
    for adapter in ("CCTTAAGG", "ACGTNACG", "A", "TTTTTTTTTTT"):
        seqs = ["".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 24))) for _ in range(80)] + ["GG" + adapter + "AC", adapter[:3] or "A", "AC" + adapter[:5]]
        got = clip.align_all(pd.Series(seqs), adapter)
        for s, row in zip(seqs, got.to_dict("records")):
            want = _align_one(s, adapter)
            assert {k: row[k] for k in want} == want, (s, adapter)


def test_reads_of_all_lengths_align_together(monkeypatch):
    rng, calls, align = random.Random(11), [], clip.align
    monkeypatch.setattr(clip, "align", lambda *a: calls.append(1) or align(*a))
    adapter = "".join(rng.choice("ACGT") for _ in range(40))
    bases = lambda n: "".join(rng.choices("ACGTN", weights=[5, 5, 5, 5, 1], k=n))
    gapped = [bases(rng.randint(0, 20)) + adapter[:18] + middle + adapter[18 + lost :] + bases(rng.randint(0, 9)) for middle, lost in [("", 0), ("G", 0), ("", 1), ("TA", 0), ("", 2), ("C", 1)] for _ in range(5)]
    seqs = [None, "", "N", "acgt", *gapped, *[bases(n) for n in range(1, 60)]]
    for more in ([], [bases(600) + adapter + bases(400)]):  # the long one takes wider numbers
        calls.clear()
        got = clip.align_all(pd.Series(seqs + more), adapter).to_dict("records")
        assert len(calls) == 1 and sum(row["gaps"] > 0 for row in got) >= 10
        for s, row in zip(seqs + more, got, strict=True):
            want = _align_one(s, adapter) if s else dict.fromkeys(row, 0)
            assert {k: row[k] for k in want} == want, (s, adapter)
    with pytest.raises(ValueError):
        clip.align_all(pd.Series(["ACG\u00e9"]), adapter)


def test_clipping_aligns_each_read_once(spark):
    df = fq(spark, ("a", "GATTACACCTTAAGG", [30] * 15))
    for clipped in (df.transform(clip.clip("CCTTAAGG")), df.transform(clip.dispositions("CCTTAAGG")).where("disposition = 'kept' and name = 'a'")):
        plan = clipped._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
        assert out(clipped) == [("a", "GATTACA")]


def test_clipping_and_dispositions(spark):
    adapter = "CCTTAAGG"
    df = fq(spark, *[(n, s, [30] * len(s)) for n, s in [("full", "ACGTACGTAC" + adapter), ("only", adapter + "ACG"), ("none", "GATTACAGATTACA"), ("short", "ACG" + adapter), ("n", "ACNTACGTAC" + adapter)]])
    got = dict(out(df.transform(clip.dispositions(adapter)), "name", "disposition"))
    assert got == {"full": "kept", "only": "adapter_only", "none": "kept", "short": "too_short", "n": "has_n"}
    assert out(df.transform(clip.clip(adapter, clipped_only=True, keep_n=True)), "name", "seq") == [("full", "ACGTACGTAC"), ("n", "ACNTACGTAC")]
    assert out(df.transform(clip.clip(adapter, unclipped_only=True))) == [("none", "GATTACAGATTACA")]
    assert out(df.transform(clip.clip(adapter, adapter_only=True))) == [("only", adapter + "ACG")]
    assert all(len(q) == len(s) for s, q in out(df.transform(clip.clip(adapter)), "seq", "qual"))
    assert metrics.clip_report(df.transform(clip.dispositions(adapter))).count() == 4
    assert clip.clip_table(df, [(adapter, "x"), ("GATTACA", "y")]).select("adapter").distinct().count() == 2


def test_metrics_and_charts(spark):
    df = fa(spark, ("1-3", "ACGTN"), ("x", "AAAA"))
    r = metrics.report(df, df.transform(filters.without_n())).first()
    assert (r.input_sequences, r.input_reads, r.output_reads, r.discarded_reads, r.discarded_percent) == (2, 4, 1, 3, 75)
    q = fq(spark, ("a", "ACGT", [1, 30, 1, 30]))
    assert tuple(metrics.masked_report(q).first()) == (1, 1, 2)
    assert tuple(metrics.masked_report(fq(spark, ("a", "NCN", [1, 2, 30]), ("b", "AC", [30, 30]))).first()) == (2, 1, 2)
    assert tuple(metrics.changed_report(fa(spark, ("2-5", "TTA"), ("x", "A"))).first()) == (6, 2)
    report = stats.cycle_stats(q)
    assert charts.box_plot(stats.box_plot(report).collect()).count("<rect") == 4
    rows = stats.composition(report).collect()
    assert sum(r.pct for r in rows if r.cycle == 1) == 100 and "<svg" in charts.composition(rows) and charts.composition(rows, lines=True).count("<polyline") == 5
    assert "<svg" in charts.length_bars(collapse.length_histogram(df).collect())
    with pytest.raises(ValueError):
        barcode.assign_barcodes(CODES, "middle")
    assert OrderedOperatorError.__mro__[1] is ValueError


def test_wrap_and_tabulate(spark):
    df = fa(spark, ("a b", "ACGTACGT"), ("e", ""), ("c", "ACGT"))
    assert [s for _, s in out(df.transform(project.reformat(4)))] == ["ACGT\nACGT", "ACGT"]
    assert [x for (x,) in out(df.transform(project.tabulate(True)), "line")] == ["a b\tACGTACGT", "e", "c\tACGT"]
    h = df.select(R.hamming(F.lit("ACG"), F.lit("AT")).alias("h")).first().h
    assert h == 2 and df.select(R.hamming_to(F.lit("ACG"), "AT", 3).alias("h")).first().h == 2


def test_rename_counts_the_reads_it_is_given(spark):
    df = fq(spark, *[(f"r{i}", "ACGT", [5 if i % 3 else 30] * 4) for i in range(9)])
    kept = df.transform(filters.quality_filter(20, 100))
    assert out(kept.transform(project.rename("COUNT")), "ord", "name", "name2") == [(0, "1", "1"), (3, "2", "2"), (6, "3", "3")]


def test_reports_as_text(spark):
    q = fq(spark, ("a", "ACGT", [1, 30, 1, 30]), ("b", "ACNT", [30] * 4))
    assert metrics.mask_lines(metrics.masked_report(q), 10, "x") == ["Minimum Quality Threshold: 10", "Low-quality nucleotides replaced with 'x'", "Input: 2 reads.", "Output: 2 reads.", "Masked reads: 1", "Masked nucleotides: 2"]
    report = metrics.report(q, q.transform(filters.without_n()))
    assert metrics.run_lines(report, "to_fasta") == ["Input: 2 reads.", "Output: 1 reads.", "discarded 1 (50%) low-quality reads."]
    assert metrics.run_lines(report, "trim", ["Trimming: base 1 to 3"])[0] == "Trimming: base 1 to 3"
    c = fa(spark, ("1-3", "AC"), ("2-1", "AC"))
    assert metrics.collapse_lines(metrics.report(c, c.transform(collapse.collapse()))) == ["Input: 2 sequences (representing 4 reads)", "Output: 1 sequences (representing 4 reads)"]
    assert metrics.change_lines(metrics.changed_report(q))[-1] == "Nucleotides changed: 2"
    adapter = "CCTTAAGG"
    reads = fq(spark, *[(n, s, [30] * len(s)) for n, s in [("full", "ACGTACGTAC" + adapter), ("only", adapter + "ACG"), ("n", "ACNTACGTAC" + adapter)]])
    assert metrics.clip_lines(metrics.clip_report(reads.transform(clip.dispositions(adapter))), adapter) == [
        f"Clipping Adapter: {adapter}", "Min. Length: 5", "Input: 3 reads.", "Output: 1 reads.", "discarded 0 too-short reads.", "discarded 1 adapter-only reads.", "discarded 1 N reads."]


def test_adapter_tables(spark):
    lines = ["# comment", "", "cctTAAGG\tfirst one", "GATTACA"]
    assert clip.parse_adapters(lines) == [("CCTTAAGG", "first one"), ("GATTACA", "GATTACA")]
    with pytest.raises(ValueError):
        clip.parse_adapters(["AXB\ty"])
    rng = random.Random(11)
    reads = fq(spark, *[(str(i), s, [30] * len(s)) for i, s in enumerate("".join(rng.choice("ACGT") for _ in range(rng.randint(9, 30))) + rng.choice(["CCTTAAGG", "GATTACA", ""]) for _ in range(40))])
    table = clip.parse_adapters(lines)
    got = sorted((r.adapter, r.ord, r.seq, tuple(r.qual)) for r in clip.clip_table(reads, table).collect())
    want = sorted((d, r.ord, r.seq, tuple(r.qual)) for s, d in table for r in reads.transform(clip.clip(s)).collect())
    assert got == want


def test_functions_for_sql(spark):
    from strandlake.functions import register

    names = register.register(spark)
    fa(spark, ("67-3461", "ACGTN"), ("x", "AA")).createOrReplaceTempView("sql_reads")
    rows = spark.sql("select reads_count(name) a, reads_count_tabular(name) b, reads_count_histogram(name) c, reverse_complement(seq) d, base_count(seq, 'A') e, hamming_distance(seq, 'ACT') f, encode_quality(decode_quality('I!', 33), 33) g, encode_quality_numeric(decode_quality('I!', 33)) h, read_percent(1, 3) i from sql_reads order by ord").collect()
    assert tuple(rows[0]) == (3461, 3461, 3461, "NACGT", 1, 3, "I!", "40 0", 33) and tuple(rows[1])[:6] == (1, 1, 1, "TT", 2, 1)
    got = spark.sql("select align_adapter(seq, adapter) a from values ('ACGTACGTACCCTTAAGG', 'CCTTAAGG'), ('GGACGT', 'ACG') as t(seq, adapter)").collect()
    assert [(r.a.query_start, r.a.matches) for r in got] == [(10, 8), (2, 3)] and "align_adapter" in names
