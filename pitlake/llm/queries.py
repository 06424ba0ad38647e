"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op6_byte_bpe
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .html_text import op7_html_text
from .langid import op8_language_id
from .lattice import op2_lattice_scores
from .neardup import op10_near_dedup
from .packing import op9_best_fit_packing
from .pii import op3_pseudonyms
from .quality import op5_quality_rules
from .substring import op1_substring_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_lattice_scores, op3_pseudonyms, op4_exact_dedup, op5_quality_rules, op6_byte_bpe, op7_html_text, op8_language_id, op9_best_fit_packing, op10_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL}
