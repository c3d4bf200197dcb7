"""Queries of this subpackage and, where SQL can state them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .alignment import op12_alignment
from .bpe import op4_bpe
from .chat_format import op1_chat_format
from .decontaminate import op7_decontaminate
from .fill_middle import op13_fill_middle
from .language_id import op10_language_id
from .near_dedup import op8_near_dedup
from .quality_rules import op2_quality_rules
from .secret_scan import op11_secrets
from .substring_dedup import op5_substring_dedup
from .token_scan import op9_token_scan
from .toxicity import op6_toxicity
from .warc import op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc": op3_warc,
    "op4_bpe": op4_bpe,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_decontaminate": op7_decontaminate,
    "op8_near_dedup": op8_near_dedup,
    "op9_token_scan": op9_token_scan,
    "op10_language_id": op10_language_id,
    "op11_secrets": op11_secrets,
    "op12_alignment": op12_alignment,
    "op13_fill_middle": op13_fill_middle,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": oracles.OP1,
    "op3_warc": oracles.OP3,
    "op5_substring_dedup": oracles.OP5,
    "op13_fill_middle": oracles.OP13,
}
