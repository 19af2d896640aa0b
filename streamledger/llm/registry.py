"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from streamledger.llm import bpe, chat, decontamination, hard_negatives, html_extraction, jaccard, langid, licences, media, merkle, sharding, toxicity, warc

QUERIES = {
    "op1_license_scans": licences.op1_license_scans,
    "op2_media_columns": media.op2_media_columns,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_warc": warc.op4_warc,
    "op5_benchmark_decontamination": decontamination.op5_benchmark_decontamination,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_bpe_encoding": bpe.op7_bpe_encoding,
    "op8_language_id": langid.op8_language_id,
    "op9_html_extraction": html_extraction.op9_html_extraction,
    "op10_ngram_jaccard_join": jaccard.op10_ngram_jaccard_join,
    "op11_sharding": sharding.op11_sharding,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_merkle": merkle.op13_merkle,
}

SQL = {
    "op1_license_scans": licences.SQL,
    "op3_chat_formatting": chat.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_benchmark_decontamination": decontamination.OP5_SQL,
    "op10_ngram_jaccard_join": jaccard.SQL,
    "op11_sharding": sharding.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
