"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from tallyloom.llm import embeddings, html_text, language, minhash, mixing, packing, quality, secret_scan, suffixes, token_store

QUERIES = {
    "op1_suffix_repeats": suffixes.op1_suffix_repeats,
    "op2_html_text": html_text.op2_html_text,
    "op3_language": language.op3_language,
    "op4_packing": packing.op4_packing,
    "op5_token_store": token_store.op5_token_store,
    "op6_quality": quality.op6_quality,
    "op7_embeddings": embeddings.op7_embeddings,
    "op8_minhash": minhash.op8_minhash,
    "op9_secrets": secret_scan.op9_secrets,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {
    "op6_quality": quality.ORACLE,
    "op7_embeddings": embeddings.ORACLE,
    "op8_minhash": minhash.ORACLE,
    "op9_secrets": secret_scan.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
