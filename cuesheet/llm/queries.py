"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuesheet.llm import decontamination, exact, language, negatives, packing, pieces, privacy, quality, records, resampling, sharding, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": decontamination.op1_benchmark_decontamination,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_extendible_sharding": sharding.op3_extendible_sharding,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_exact_dedup": exact.op5_exact_dedup,
    "op6_personal_data": privacy.op6_personal_data,
    "op7_token_records": records.op7_token_records,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_packing": packing.op9_packing,
    "op10_language_id": language.op10_language_id,
    "op11_sentencepiece": pieces.op11_sentencepiece,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}

SQL: dict[str, str] = {
    "op3_extendible_sharding": sharding.OP3_SQL,
    "op5_exact_dedup": exact.OP5_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
}
