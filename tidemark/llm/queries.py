"""The queries of this subpackage and their DuckDB SQL, by the names that the entry file registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op3_bpe
from .license_scan import op7_license_scan
from .main_text import op2_html_extraction
from .media import op1_media_columns
from .mixing import op5_mixing
from .near_dedup import OP9_SQL, op9_near_dedup
from .neighbours import op4_nearest
from .repeats import op8_suffix_dedup
from .toxicity import op10_toxicity
from .url_filter import OP6_SQL, op6_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_html_extraction": op2_html_extraction,
    "op3_bpe": op3_bpe,
    "op4_nearest": op4_nearest,
    "op5_mixing": op5_mixing,
    "op6_url_filter": op6_url_filter,
    "op7_license_scan": op7_license_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_toxicity": op10_toxicity,
}

ORACLES: dict[str, str] = {"op6_url_filter": OP6_SQL, "op9_near_dedup": OP9_SQL}
