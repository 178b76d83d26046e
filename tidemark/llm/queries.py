"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, language, neardup, ngram, quality, shards, tokens, urls

QUERIES = {
    "op1_chat_snapshots": chat.op1_chat_snapshots,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_stratified_shards": shards.op3_stratified_shards,
    "op4_url_filters": urls.op4_url_filters,
    "op5_superminhash": neardup.op5_superminhash,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_benchmark_leaks": decontaminate.op7_benchmark_leaks,
    "op8_language_id": language.op8_language_id,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_ngram_trie": ngram.op10_ngram_trie,
}

ORACLES = {
    "op1_chat_snapshots": chat.OP1_SQL,
    "op4_url_filters": urls.OP4_SQL,
}
