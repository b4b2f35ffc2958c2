"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from veraframe.llm import bpe, chat_format, exact_dedup, html_extract, importance_resampling, jaccard_join, language_id, media_columns, mixing, prefix_trie, sharding, token_counts, warc

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_language_id": language_id.op3_language_id,
    "op4_media_columns": media_columns.op4_media_columns,
    "op5_ring_sharding": sharding.op5_ring_sharding,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_html_extraction": html_extract.op7_html_extraction,
    "op8_mixing": mixing.op8_mixing,
    "op9_warc": warc.op9_warc,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_importance_resampling": importance_resampling.op11_importance_resampling,
    "op12_chat_format": chat_format.op12_chat_format,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {
    "op8_mixing": mixing.oracle(),
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_chat_format": chat_format.ORACLE_SQL,
    "op13_prefix_trie": prefix_trie.ORACLE_SQL,
}
