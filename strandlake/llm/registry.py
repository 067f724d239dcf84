"""The operators' queries and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from . import mixing, url_cascade
from .hnsw import op4_hnsw
from .kd_shards import op2_kd_shards
from .language import op3_language
from .mixing import op10_mixing
from .secrets import op9_secrets
from .simhash import op8_simhash
from .spaced_seeds import op6_spaced_seeds
from .suffix_dedup import op1_suffix_dedup
from .toxicity import op7_toxicity
from .url_cascade import op5_url_cascade


def queries() -> dict:
    found = (op1_suffix_dedup, op2_kd_shards, op3_language, op4_hnsw, op5_url_cascade, op6_spaced_seeds, op7_toxicity, op8_simhash, op9_secrets, op10_mixing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_cascade": url_cascade.SQL, "op10_mixing": mixing.SQL}
