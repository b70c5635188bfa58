"""Queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.chat import OP6_SQL, op6_chat_format
from tidemark.llm.fingerprint import op4_fingerprints
from tidemark.llm.language import op9_language_id
from tidemark.llm.neardup import op7_near_dedup
from tidemark.llm.packing import op10_packing
from tidemark.llm.quality_ordinal import op8_quality_ordinal
from tidemark.llm.quality_rules import op3_quality_rules
from tidemark.llm.sharding import op1_sharding
from tidemark.llm.substring_dedup import op2_substring_dedup
from tidemark.llm.tokens import op5_bpe


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_quality_rules": op3_quality_rules,
        "op4_fingerprints": op4_fingerprints,
        "op5_bpe": op5_bpe,
        "op6_chat_format": op6_chat_format,
        "op7_near_dedup": op7_near_dedup,
        "op8_quality_ordinal": op8_quality_ordinal,
        "op9_language_id": op9_language_id,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_format": OP6_SQL}
