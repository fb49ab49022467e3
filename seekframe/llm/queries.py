"""The queries of the training-data operators, over the whole `documents` table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, licenses, line_dedup, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, token_files
from ._common import documents


def _on_documents(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": _on_documents(mixing.op1),
    "op2_token_files": _on_documents(token_files.op2),
    "op3_personal_data": _on_documents(pii.op3),
    "op4_pack_windows": _on_documents(packing.op4),
    "op5_license_scan": _on_documents(licenses.op5),
    "op7_quality_rules": _on_documents(quality_rules.op7),
    "op6_fingerprints": _on_documents(fingerprints.op6),
    "op8_near_dedup": _on_documents(near_dedup.op8),
    "op9_quality_classifier": quality_classifier.op9,
    "op10_line_dedup": _on_documents(line_dedup.op10),
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE,
    "op3_personal_data": pii.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op8_near_dedup": near_dedup.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
}
