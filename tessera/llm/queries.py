"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, html, language, licenses, lines, manifest, minhash, periods, prefixes, quality, sharding, tokens


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_line_dedup": lines.op2_line_dedup,
        "op3_near_duplicates": minhash.op3_near_duplicates,
        "op4_packing": tokens.op4_packing,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_language_id": language.op6_language_id,
        "op7_chroma_fingerprints": audio.op7_chroma_fingerprints,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_main_text": html.op9_main_text,
        "op10_bpe": tokens.op10_bpe,
        "op11_prefix_counts": prefixes.op11_prefix_counts,
        "op12_manifest": manifest.op12_manifest,
        "op13_period_runs": periods.op13_period_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": sharding.OP1_SQL,
        "op2_line_dedup": lines.OP2_SQL,
        "op5_license_scan": licenses.OP5_SQL,
        "op8_quality_rules": quality.OP8_SQL,
        "op12_manifest": manifest.OP12_SQL,
    }
