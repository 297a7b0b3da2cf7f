"""The queries of this package and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from mosaiq.llm import (
    embedding_dedup, html_extract, language_model, licenses, mixing, near_dedup, packing, quality_classifier, quality_rules, toxicity,
)

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_quality_trees": quality_classifier.op4_quality_trees,
    "op5_kneser_ney": language_model.op5_kneser_ney,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_embedding_neardup": embedding_dedup.op7_embedding_neardup,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_bagminhash": near_dedup.op10_bagminhash,
}
ORACLE_SQL = {
    "op2_source_mix": mixing.OP2_SQL,
    "op7_embedding_neardup": embedding_dedup.OP7_SQL,
    "op8_license_scan": licenses.oracle_sql(),
    "op10_bagminhash": near_dedup.OP10_SQL,
}
