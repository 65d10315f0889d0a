"""The queries of this subpackage for the registry: opN_<name>, the pipeline, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tessel.llm import bpe, centroids, chat, embedding_dedup, hard_negatives, html_text, line_dedup, mixing, near_dedup, pii, quality_classifier, quality_rules, secrets

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_embedding_near_dedup": embedding_dedup.op3_embedding_near_dedup,
    "op4_pii": pii.op4_pii,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op9_html_extraction": html_text.op9_html_extraction,
    "op10_secret_scans": secrets.op10_secret_scans,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_chat_formatting": chat.op12_chat_formatting,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op2_quality_rules": quality_rules.SQL,
    "op3_embedding_near_dedup": embedding_dedup.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op7_mixing": mixing.SQL,
    "op8_minhash_near_dedup": near_dedup.SQL,
    "op10_secret_scans": secrets.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_chat_formatting": chat.SQL,
    "op13_centroid_clustering": centroids.SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
