"""Scalar functions for SQL: ``register(spark)`` makes them temporary functions of the session.

All but ``align_adapter`` are SQL expressions, which the optimizer inlines into the query; that one is an Arrow-batched function.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.clip import ALIGNMENT, FIELDS, align_all

#: name: (parameters, result, expression); multiplicity rules as in ``functions.reads``.
FUNCTIONS = {
    "reads_count": ("name string", "bigint", r"greatest(coalesce(try_cast(nullif(regexp_extract(name, r'^[^-]*-\s*\+?(\d+)', 1), '') as bigint), 1), 1)"),
    "reads_count_tabular": ("field string", "bigint", r"greatest(coalesce(try_cast(nullif(regexp_extract(regexp_replace(field, r'^[^-]*-', ''), r'^\s*\+?(\d+)$', 1), '') as bigint), 1), 1)"),
    "reads_count_histogram": ("name string", "bigint", r"coalesce(try_cast(nullif(regexp_extract(name, r'^[^-]+-(\d+)$', 1), '') as bigint), 1)"),
    "complement": ("seq string", "string", "translate(seq, 'ACGTNacgtn', 'TGCANtgcan')"),
    "reverse_complement": ("seq string", "string", "reverse(translate(seq, 'ACGTNacgtn', 'TGCANtgcan'))"),
    "base_count": ("seq string, base string", "int", "length(seq) - length(replace(seq, base, ''))"),
    "hamming_distance": ("fragment string, code string", "int", "length(fragment) - size(filter(sequence(1, greatest(length(fragment), 1)), i -> substring(fragment, i, 1) = substring(code, i, 1) and i <= length(fragment)))"),
    "decode_quality": ("line string, offset int", "array<int>", "if(line = '', cast(array() as array<int>), transform(split(line, ''), c -> ascii(c) - offset))"),
    "encode_quality": ("qual array<int>, offset int", "string", "array_join(transform(qual, q -> chr(q + offset)), '')"),
    "encode_quality_numeric": ("qual array<int>", "string", "array_join(transform(qual, q -> cast(q as string)), ' ')"),
    "read_percent": ("part bigint, whole bigint", "bigint", "if(whole = 0, 0, cast(floor(part * 100 / whole) as bigint))"),
}


def _align(seqs: pd.Series, adapters: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame(index=seqs.index, columns=[*FIELDS, "score"])
    for adapter, rows in adapters.groupby(adapters):
        out.loc[rows.index] = align_all(seqs.loc[rows.index], adapter).to_numpy()
    return out.astype({**dict.fromkeys(FIELDS, "int32"), "score": "float32"})


def register(spark: SparkSession) -> list[str]:
    """Names of the functions: those of ``FUNCTIONS`` and ``align_adapter(seq, adapter)``, the best half-local alignment as a struct."""
    for name, (parameters, result, expression) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns {result} return {expression}")
    spark.udf.register("align_adapter", F.pandas_udf(_align, ALIGNMENT))
    return [*FUNCTIONS, "align_adapter"]
