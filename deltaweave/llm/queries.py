"""The registered queries of this subpackage, their SQL, and nothing else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontamination import op6_decontamination
from .html_extraction import op7_html_extraction
from .license_scan import OP3_SQL, op3_license_scan
from .quality_classifier import op2_quality_classifier
from .quality_rules import op8_quality_rules
from .sentencepiece_bpe import op5_sentencepiece
from .simhash import op9_simhash
from .tool_calls import OP4_SQL, op4_tool_calls
from .url_filters import OP1_SQL, op1_url_filters
from .warc_fixity import OP10_SQL, op10_warc_fixity

SQL: dict[str, str] = {"op1_url_filters": OP1_SQL, "op3_license_scan": OP3_SQL, "op4_tool_calls": OP4_SQL, "op10_warc_fixity": OP10_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filters, op2_quality_classifier, op3_license_scan, op4_tool_calls, op5_sentencepiece, op6_decontamination, op7_html_extraction, op8_quality_rules, op9_simhash, op10_warc_fixity)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
