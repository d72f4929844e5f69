"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from ringloom.llm import archives, classifier, embeddings, licenses, losses, mixing, negatives, pieces, quality, resampling, secrets, shingles, urls


def queries() -> dict:
    return {
        "op1_sentencepiece": pieces.op1_sentencepiece,
        "op2_cross_entropy_difference": losses.op2_cross_entropy_difference,
        "op3_url_filter": urls.op3_url_filter,
        "op4_mixing": mixing.op4_mixing,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_quality_classifier": classifier.op6_quality_classifier,
        "op7_warc": archives.op7_warc,
        "op8_embedding_near_dedup": embeddings.op8_embedding_near_dedup,
        "op9_secrets": secrets.op9_secrets,
        "op10_jaccard_join": shingles.op10_jaccard_join,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_importance_resampling": resampling.op12_importance_resampling,
        "op13_license_scan": licenses.op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_cross_entropy_difference": losses.OP2_SQL,
        "op3_url_filter": urls.OP3_SQL,
        "op4_mixing": mixing.OP4_SQL,
        "op5_quality_rules": quality.OP5_SQL,
        "op7_warc": archives.OP7_SQL,
        "op11_hard_negatives": negatives.OP11_SQL,
        "op12_importance_resampling": resampling.OP12_SQL,
        "op13_license_scan": licenses.OP13_SQL,
    }
