"""Queries of this folder's operators and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .divergence import OP13_SQL, op13_source_divergence
from .fill_middle import OP12_SQL, op12_fill_middle
from .language_id import op3_language_id
from .license_scan import op9_license_scan
from .lm_scoring import op1_ppm_scoring
from .mixing import OP7_SQL, op7_mix_sources
from .packing import op10_best_fit_packing
from .pii import op6_pii_surrogates
from .quality import op5_compression_bands
from .simhash import op4_simhash
from .token_store import op11_token_store
from .topk import OP2_SQL, op2_bit_sliced_topk
from .warc import OP8_SQL, op8_warc_revisits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ppm_scoring": op1_ppm_scoring,
    "op2_bit_sliced_topk": op2_bit_sliced_topk,
    "op3_language_id": op3_language_id,
    "op4_simhash": op4_simhash,
    "op5_compression_bands": op5_compression_bands,
    "op6_pii_surrogates": op6_pii_surrogates,
    "op7_mix_sources": op7_mix_sources,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_license_scan": op9_license_scan,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_token_store": op11_token_store,
    "op12_fill_middle": op12_fill_middle,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {"op2_bit_sliced_topk": OP2_SQL, "op7_mix_sources": OP7_SQL, "op8_warc_revisits": OP8_SQL, "op12_fill_middle": OP12_SQL, "op13_source_divergence": OP13_SQL}
