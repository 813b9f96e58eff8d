"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import dart_minhash, decontamination, embeddings, filter_audit, hard_negatives, html_text, language, language_model, packing, personal_data, quality, secret_scan, token_files


def queries() -> dict:
    return {
        "op1_html_text": html_text.op1_html_text,
        "op2_language": language.op2_language,
        "op3_nnls_packing": packing.op3_nnls_packing,
        "op4_pstable_vectors": embeddings.op4_pstable_vectors,
        "op5_quality": quality.op5_quality,
        "op6_dart_minhash": dart_minhash.op6_dart_minhash,
        "op7_contained_items": decontamination.op7_contained_items,
        "op8_personal_data": personal_data.op8_personal_data,
        "op9_language_model": language_model.op9_language_model,
        "op10_token_files": token_files.op10_token_files,
        "op11_recursive_secrets": secret_scan.op11_recursive_secrets,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_contained_items": decontamination.oracle(), "op12_hard_negatives": hard_negatives.oracle(), "op13_filter_audit": filter_audit.oracle()}
