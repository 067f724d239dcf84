"""Registered queries of the read operators, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reads as R
from ..operators import barcode, clip, collapse, filters, metrics, project, stats
from .derive import reads, sql

ADAPTER = "ACGTCCA"
BARCODES = [("BC1", "ACGTA"), ("BC2", "CCGTT"), ("BC3", "GTACG"), ("BC4", "TTACA")]
_LOW20 = "!#&*/3"  # qualities below 20 in the derived reads' alphabet
_Q: dict[str, tuple] = {}


def query(oracle: str | None):
    def add(f):
        _Q[f.__name__] = (f, oracle)
        return f

    return add


def queries() -> dict:
    return {k: f for k, (f, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for k, (_, q) in _Q.items() if q}


def _shown(df, *more):
    return df.select("ord", "name", "seq", R.encode_ascii().alias("q"), *more)


_RANKED = "select row_number() over (order by cnt desc, seq)::bigint as rank, seq, cnt from (select seq, count(*)::bigint as cnt from {} group by seq)"
_LOW = f"(length(q) - length(translate(q, '{_LOW20}', '')))"
L, O, P = sql("lineitem"), sql("orders"), sql("part")


@query(_RANKED.format(f"(select substr(seq, 1, 14) as seq from {L} where {_LOW} * 100 <= length(q) * 40 - (length(q) * 40) % 100)"))
def collapse_pipeline(spark, d):
    kept = reads(spark, d).transform(filters.quality_filter(20, 60)).transform(project.trim(1, 14))
    return collapse.ranked(collapse.counts(kept)).select("rank", "seq", "cnt")


@query(f"select concat(rank, '-', cnt) as name, seq from ({_RANKED.format(L)})")
def collapse_reads(spark, d):
    return reads(spark, d).transform(collapse.collapse()).select("name", "seq")


@query(f"select concat(row_number() over (order by cnt desc, seq), '-', cnt) as name, seq from (select seq, sum(greatest(split_part(name, '-', 2)::bigint, 1))::bigint as cnt from {P} group by seq)")
def collapse_again(spark, d):
    return reads(spark, d, "part", fasta=True).transform(collapse.collapse()).select("name", "seq")


@query(f"select ord, name, reverse(translate(seq, 'ACGT', 'TGCA')) as seq, reverse(q) as q from {L}")
def reverse_complement(spark, d):
    return _shown(reads(spark, d).transform(project.reverse_complement()))


@query(f"select ord, name, seq, q from {L} where {_LOW} * 100 <= length(q) * 40 - (length(q) * 40) % 100")
def quality_filter(spark, d):
    return _shown(reads(spark, d).transform(filters.quality_filter(20, 60)))


@query(f"""select ord, name, seq, q from (select ord, name, q, case when ord % 9 = 0 then substr(concat('AAAAAAAAAAAAAAAAAA', seq), 1, length(seq)) else seq end as seq from {L})
where greatest(length(seq) - length(replace(seq, 'A', '')), length(seq) - length(replace(seq, 'C', '')), length(seq) - length(replace(seq, 'G', '')), length(seq) - length(replace(seq, 'T', ''))) < length(seq) - 3""")
def artifacts_filter(spark, d):
    low = F.when(F.col("ord") % 9 == 0, F.substring(F.concat(F.lit("A" * 18), "seq"), F.lit(1), F.length("seq"))).otherwise(F.col("seq"))
    return _shown(reads(spark, d).withColumn("seq", low).transform(filters.artifacts()))


@query(f"select ord, name, seq, q from {L} where seq not like '%N%' and length(seq) >= 20")
def length_and_n_filter(spark, d):
    return _shown(reads(spark, d).transform(filters.without_n()).transform(filters.min_length(20)).transform(filters.not_empty()))


@query(f"select ord, name, substr(seq, 3, 16) as seq, substr(q, 3, 16) as q from {L}")
def trim_position(spark, d):
    return _shown(reads(spark, d).transform(project.trim(3, 18)))


@query(f"select ord, name, substr(seq, 1, length(seq) - 5) as seq, substr(q, 1, length(q) - 5) as q from {L} where length(seq) > 5 and length(seq) - 5 >= 12")
def trim_end(spark, d):
    return _shown(reads(spark, d).transform(project.trim_end(5, 12)))


@query(f"select ord, name, substr(seq, 1, n::int) as seq, substr(q, 1, n::int) as q from (select *, length(regexp_replace(q, '[{_LOW20}]+$', '')) as n from {L}) where n >= 10")
def quality_trim(spark, d):
    return _shown(reads(spark, d).transform(project.quality_trim(20, 10)))


@query(f"select ord, name, list_aggregate(list_transform(range(1, length(seq) + 1), lambda i: case when contains('{_LOW20}', substr(q, i::int, 1)) then 'x' else substr(seq, i::int, 1) end), 'string_agg', '') as seq, q from {L}")
def mask(spark, d):
    return _shown(reads(spark, d).transform(project.mask(20, "x")))


@query(f"select ord, seq as name, seq as name2, seq from {L}")
def rename_seq(spark, d):
    return reads(spark, d).transform(project.rename("SEQ")).select("ord", "name", "name2", "seq")


@query(f"select ord, cast(row_number() over (order by ord) as varchar) as name, seq from {O} where {_LOW} * 100 <= length(q) * 40 - (length(q) * 40) % 100")
def rename_count(spark, d):
    return reads(spark, d, "orders").transform(filters.quality_filter(20, 60)).transform(project.rename("COUNT")).select("ord", "name", "seq")


@query(f"select ord, name, replace(seq, 'T', 'U') as seq, 'fasta' as fmt from {L}")
def dna_to_rna(spark, d):
    return reads(spark, d).transform(project.dna_to_rna()).select("ord", "name", "seq", "fmt")


@query(f"select ord, name, seq from {L}")
def rna_round_trip(spark, d):
    return reads(spark, d).transform(project.dna_to_rna()).transform(project.rna_to_dna()).select("ord", "name", "seq")


@query(f"select ord, cast(row_number() over (order by ord) as varchar) as name, seq from {O} where seq not like '%N%'")
def fastq_to_fasta_rename(spark, d):
    return reads(spark, d, "orders").transform(project.to_fasta(rename=True)).select("ord", "name", "seq")


@query(f"select ord, list_aggregate(list_transform(string_split(q, ''), lambda c: cast(ascii(c) - 33 as varchar)), 'string_agg', ' ') as q, 'fastq_numeric' as fmt from {L}")
def encode_numeric(spark, d):
    return reads(spark, d).transform(project.convert_quality(True)).select("ord", R.encode_numeric().alias("q"), "fmt")


@query(f"select ord, q, 'fastq_ascii' as fmt from {L}")
def encode_ascii(spark, d):
    numeric = reads(spark, d).withColumn("qual", R.decode_numeric(R.encode_numeric()))
    return numeric.transform(project.convert_quality(False)).select("ord", R.encode_ascii().alias("q"), "fmt")


@query(f"select ord, name, case when length(seq) <= 10 then seq when length(seq) <= 20 then concat(substr(seq, 1, 10), chr(10), substr(seq, 11)) else concat(substr(seq, 1, 10), chr(10), substr(seq, 11, 10), chr(10), substr(seq, 21)) end as seq from {L}")
def fasta_wrap(spark, d):
    return reads(spark, d, fasta=True).transform(project.reformat(10)).select("ord", "name", "seq")


@query(f"select ord, concat(name, chr(9), seq) as line from {L}")
def fasta_tabular(spark, d):
    return reads(spark, d, fasta=True).transform(project.tabulate())


@query(f"select ord, greatest(coalesce(try_cast(nullif(regexp_extract(name, '^[^-]*-\\s*\\+?(\\d+)', 1), '') as bigint), 1), 1) as n from (select ord, concat(name, 'x') as name from {P})")
def reads_count_core(spark, d):
    return reads(spark, d, "part", fasta=True).select("ord", R.reads_count(F.concat("name", F.lit("x"))).alias("n"))


@query(f"select ord, greatest(coalesce(try_cast(nullif(regexp_extract(regexp_replace(name, '^[^-]*-', ''), '^\\s*\\+?(\\d+)$', 1), '') as bigint), 1), 1) as n from {P}")
def reads_count_tabular(spark, d):
    return reads(spark, d, "part", fasta=True).select("ord", R.reads_count_tabular("name").alias("n"))


@query(f"select ord, coalesce(try_cast(nullif(regexp_extract(name, '^[^-]+-(\\d+)$', 1), '') as bigint), 1) as n from {P}")
def reads_count_histogram(spark, d):
    return reads(spark, d, "part", fasta=True).select("ord", R.reads_count_histogram().alias("n"))


@query(f"select cast(o + k as varchar) as name, seq from (select seq, unnest(range(1, c + 1)) as k, o from (select seq, c, (sum(c) over (order by ord) - c)::bigint as o from (select *, split_part(name, '-', 2)::bigint as c from {P})))")
def uncollapse(spark, d):
    return reads(spark, d, "part", fasta=True).transform(collapse.uncollapse()).select("name", "seq")


@query(f"select value from (select concat('x', chr(9), name) as value, unnest(range(split_part(name, '-', 2)::bigint)) from {P})")
def uncollapse_tabular(spark, d):
    lines = reads(spark, d, "part", fasta=True).select(F.concat_ws("\t", F.lit("x"), "name").alias("value"))
    return lines.transform(collapse.uncollapse_tabular(2))


@query(f"select length(seq)::int as len, sum(split_part(name, '-', 2)::bigint)::bigint as n from {P} group by 1")
def length_histogram(spark, d):
    return collapse.length_histogram(reads(spark, d, "part", fasta=True))


_CELLS = f"(select cycle::int as cycle, substr(seq, cycle::int, 1) as nuc, (ascii(substr(q, cycle::int, 1)) - 33)::int as v from (select seq, q, unnest(range(1, length(seq) + 1)) as cycle from {L}))"
_MEASURES = """count(*)::bigint as n, min(v) as mn, max(v) as mx, sum(v)::bigint as s, list_sort(list(v)) as l"""
_ELEVEN = """n as "count", mn as "min", mx as "max", s as "sum", s::double / n as mean, l[n // 4 + 1] as Q1, l[n // 2 + 1] as med, l[n * 3 // 4 + 1] as Q3, l[n * 3 // 4 + 1] - l[n // 4 + 1] as IQR,
greatest(l[n // 4 + 1] - (l[n * 3 // 4 + 1] - l[n // 4 + 1]) * 3 // 2, mn)::int as lW, least(l[n * 3 // 4 + 1] + (l[n * 3 // 4 + 1] - l[n // 4 + 1]) * 3 // 2, mx)::int as rW"""


@query(f"""select cycle as "column", {_ELEVEN}, a as "A_Count", c as "C_Count", g as "G_Count", t as "T_Count", nn as "N_Count", (max(n) over ())::bigint as "Max_count" from (select cycle, {_MEASURES}, (count(*) filter (nuc = 'A'))::bigint as a,
(count(*) filter (nuc = 'C'))::bigint as c, (count(*) filter (nuc = 'G'))::bigint as g, (count(*) filter (nuc = 'T'))::bigint as t, (count(*) filter (nuc = 'N'))::bigint as nn from {_CELLS} group by cycle)""")
def cycle_stats(spark, d):
    return stats.cycle_stats(reads(spark, d))


@query(f"select cycle, nuc, {_ELEVEN} from (select cycle, nuc, {_MEASURES} from (select * from {_CELLS} union all select cycle, 'ALL' as nuc, v from {_CELLS}) group by cycle, nuc)")
def cycle_nuc_stats(spark, d):
    return stats.cycle_nuc_stats(reads(spark, d))


def _wide(b: str, m: str) -> str:
    value = f'max(case when nuc = \'{b}\' then "{m}" end)'
    return (f"coalesce({value}, 0)::bigint" if m == "count" and b != "ALL" else value) + f' as "{b}_{m}"'


_WIDE = ", ".join(_wide(b, m) for b in ("ALL", "A", "C", "G", "T", "N") for m in stats.MEASURES)


@query(f"""select cycle, (max(max(case when nuc = 'ALL' and cycle = 1 then "count" end)) over ())::bigint as max_count, {_WIDE}
from (select cycle, nuc, {_ELEVEN} from (select cycle, nuc, {_MEASURES} from (select * from {_CELLS} union all select cycle, 'ALL' as nuc, v from {_CELLS}) group by cycle, nuc)) group by cycle""")
def cycle_nuc_wide(spark, d):
    return stats.cycle_nuc_wide(reads(spark, d))


@query(f"select cycle, nuc, count(*)::bigint as n from {_CELLS} group by all")
def nucleotide_distribution(spark, d):
    return stats.nucleotide_distribution(reads(spark, d))


@query(f"select cycle, l[n // 4 + 1] as q1, greatest(l[n // 4 + 1] - (l[n * 3 // 4 + 1] - l[n // 4 + 1]) * 3 // 2, mn)::int as lw, least(l[n * 3 // 4 + 1] + (l[n * 3 // 4 + 1] - l[n // 4 + 1]) * 3 // 2, mx)::int as rw, l[n * 3 // 4 + 1] as q3, l[n // 2 + 1] as med from (select cycle, {_MEASURES} from {_CELLS} group by cycle)")
def box_plot(spark, d):
    return stats.box_plot(stats.cycle_stats(reads(spark, d)))


@query(f"""with h as (select cycle, nuc, count(*) as n from {_CELLS} group by all), grid as (select distinct cycle, b.nuc from h, (values ('A'), ('C'), ('G'), ('T'), ('N')) as b(nuc))
select cycle, nuc, (coalesce(n, 0) * 100)::double / (select count(*) from lineitem) as pct from grid left join h using (cycle, nuc)""")
def composition(spark, d):
    return stats.composition(stats.cycle_stats(reads(spark, d)))


_FAR = " + ".join(f"(substr(seq, {i}, 1) <> substr(code, {i}, 1))::int" for i in range(1, 6))
_ASSIGNED = f"(select ord, name, seq, case when m <= 2 then ident else 'unmatched' end as barcode, case when m <= 2 then m end as distance from (select *, row_number() over (partition by ord, name, seq, k order by m, pos) as r from (select r.*, pos, ident, {_FAR} as m from (select *, row_number() over () as k from {L}) r, (values {', '.join(f'({i}, {chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for i, (a, b) in enumerate(BARCODES))}) as b(pos, ident, code))) where r = 1)"


@query(f"select ord, name, seq, barcode, coalesce(distance, -1)::int as distance from {_ASSIGNED}")
def barcode_assign(spark, d):
    return reads(spark, d).transform(barcode.assign_barcodes(BARCODES, "bol", 2)).select("ord", "name", "seq", "barcode", F.coalesce("distance", F.lit(-1)).alias("distance"))


@query(f"""with c as (select barcode, count(*) as n from {_ASSIGNED} group by barcode), b(barcode) as (values ('BC1'), ('BC2'), ('BC3'), ('BC4'), ('unmatched'))
select barcode as "Barcode", coalesce(n, 0)::bigint as "Count", concat('out_', barcode, '.txt') as "Location" from b left join c using (barcode) union all select 'total', (select count(*) from lineitem)::bigint, null""")
def barcode_split_counts(spark, d):
    assigned = reads(spark, d).transform(barcode.assign_barcodes(BARCODES, "bol", 2))
    return barcode.barcode_counts(assigned, BARCODES, "out_", ".txt")


@query(f"select ord, ({_FAR.replace('code', chr(39) + 'ACGTA' + chr(39))})::int as distance from {L}")
def hamming(spark, d):
    return reads(spark, d).select("ord", R.hamming(F.substring("seq", 1, 5), F.lit("ACGTA")).cast("int").alias("distance"))


@query(f"select ord, (length(seq) - length(replace(seq, 'A', '')))::int as a, (length(seq) - length(replace(seq, 'C', '')))::int as c, (length(seq) - length(replace(seq, 'G', '')))::int as g, (length(seq) - length(replace(seq, 'T', '')))::int as t, (length(seq) - length(replace(seq, 'N', '')))::int as n from {L}")
def base_counts(spark, d):
    return reads(spark, d).select("ord", *[R.base_count("seq", b).cast("int").alias(b.lower()) for b in "ACGTN"])


@query(f"select ord, case when seq like '%N%' then 'invalid nucleotide' end as problem from {L}")
def validate(spark, d):
    return reads(spark, d).transform(filters.validate("PERMISSIVE", allow_n=False)).select("ord", "problem")


@query(f"""select a as input_sequences, a as input_reads, b as output_sequences, b as output_reads, a - b as discarded_reads, ((a - b) * 100 // a)::bigint as discarded_percent
from (select count(*)::bigint as a, (count(*) filter ({_LOW} * 100 <= length(q) * 40 - (length(q) * 40) % 100))::bigint as b from {L})""")
def run_metrics(spark, d):
    before = reads(spark, d)
    return metrics.report(before, before.transform(filters.quality_filter(20, 60)))


@query(f"select count(*)::bigint as input_reads, (count(*) filter (m > 0))::bigint as masked_reads, sum(m)::bigint as masked_nucleotides from (select len(list_filter(string_split(q, ''), lambda c: ascii(c) - 33 < 20)) as m from {O})")
def mask_metrics(spark, d):
    return metrics.masked_report(reads(spark, d, "orders"), 20)


@query(f"select count(*)::bigint as input_reads, sum(length(seq) - length(replace(seq, 'T', '')))::bigint as changed_nucleotides from {O}")
def change_metrics(spark, d):
    return metrics.changed_report(reads(spark, d, "orders"))


@query(None)
def clip_adapter(spark, d):
    return _shown(reads(spark, d).transform(clip.clip(ADAPTER, min_length=8, keep_n=True)))


@query(None)
def clip_dispositions(spark, d):
    return metrics.clip_report(reads(spark, d).transform(clip.dispositions(ADAPTER, min_length=8)))
