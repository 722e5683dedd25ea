"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloupe.llm import ngram_join, quality_rules, substring_dedup, url_filters
from sparkloupe.llm.decontamination import op10_decontamination
from sparkloupe.llm.html_text import op8_html_text
from sparkloupe.llm.language_id import op9_language_id
from sparkloupe.llm.mixing import op7_source_mixing
from sparkloupe.llm.ngram_join import op2_ngram_join
from sparkloupe.llm.pii import op5_pii
from sparkloupe.llm.quality_rules import op6_quality_rules
from sparkloupe.llm.substring_dedup import op3_substring_dedup
from sparkloupe.llm.token_counts import op1_token_counts
from sparkloupe.llm.url_filters import op4_url_filters


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_ngram_join": op2_ngram_join,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_url_filters": op4_url_filters,
        "op5_pii": op5_pii,
        "op6_quality_rules": op6_quality_rules,
        "op7_source_mixing": op7_source_mixing,
        "op8_html_text": op8_html_text,
        "op9_language_id": op9_language_id,
        "op10_decontamination": op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": ngram_join.SQL, "op3_substring_dedup": substring_dedup.SQL, "op4_url_filters": url_filters.SQL, "op6_quality_rules": quality_rules.SQL}
