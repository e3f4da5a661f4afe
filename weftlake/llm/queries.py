"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op5_chat_format
from .lattice import op11_lattice_score
from .lines import op6_line_dedup
from .mixing import op7_mix_sources
from .negatives import OP12_SQL, op12_hard_negatives
from .packing import op2_best_fit_packing
from .quality import op3_quality_rules
from .secrets import op4_secret_scan
from .simhash import op8_simhash
from .sortmeans import OP13_SQL, op13_sort_means
from .suffixes import op1_suffix_dedup
from .urls import OP9_SQL, op9_url_filter
from .vectors import op10_embedding_dedup

QUERIES = (op1_suffix_dedup, op2_best_fit_packing, op3_quality_rules, op4_secret_scan, op5_chat_format, op6_line_dedup, op7_mix_sources, op8_simhash, op9_url_filter, op10_embedding_dedup, op11_lattice_score, op12_hard_negatives, op13_sort_means)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op9_url_filter": OP9_SQL, "op12_hard_negatives": OP12_SQL, "op13_sort_means": OP13_SQL}
