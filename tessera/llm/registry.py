"""Queries and SQL of this subpackage."""

from __future__ import annotations

from tessera.llm import byte_cnn, decontaminate, licences, mixing, quality_rules, simhash, substring_dedup, suffix_dedup, token_ids, warc


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_quality_rules": quality_rules.query,
        "op2_substring_dedup": substring_dedup.query,
        "op3_warc": warc.query,
        "op4_licence_scans": licences.query,
        "op5_suffix_array_dedup": suffix_dedup.query,
        "op6_quality_classifier": byte_cnn.query,
        "op7_token_ids": token_ids.query,
        "op8_simhash_near_dedup": simhash.query,
        "op9_decontamination": decontaminate.query,
        "op10_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring_dedup.ORACLE_SQL,
        "op3_warc": warc.ORACLE_SQL,
        "op4_licence_scans": licences.oracle_sql(),
        "op5_suffix_array_dedup": suffix_dedup.ORACLE_SQL,
        "op9_decontamination": decontaminate.ORACLE_SQL,
    }
