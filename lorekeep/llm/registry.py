"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from lorekeep.llm import bpe, chat, decontamination, exact_dedup, filter_audit, html_text, language, licenses, pii, quality, simhash, toxicity, vector_codes


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_language": language.op2_language,
        "op3_bpe": bpe.op3_bpe,
        "op4_license_scan": licenses.op4_license_scan,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_chat_format": chat.op6_chat_format,
        "op7_simhash": simhash.op7_simhash,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_html_text": html_text.op10_html_text,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_pii": pii.op13_pii,
    }


def oracle_sql() -> dict:
    return {
        "op4_license_scan": licenses.ORACLE_SQL,
        "op5_exact_dedup": exact_dedup.ORACLE_SQL,
        "op6_chat_format": chat.ORACLE_SQL,
        "op7_simhash": simhash.ORACLE_SQL,
        "op8_decontamination": decontamination.ORACLE_SQL,
        "op11_vector_codes": vector_codes.ORACLE_SQL,
        "op12_filter_audit": filter_audit.ORACLE_SQL,
    }
