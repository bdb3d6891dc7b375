"""Registered queries of this package and their SQL."""

from __future__ import annotations

from cellweave.llm import chat, mixing, packing, quality, repeats, search, sharding, simhash, spotsigs, tokens, toxicity, urls, whitening

QUERIES = {
    "op1_spot_signatures": spotsigs.query,
    "op2_best_fit_packing": packing.query,
    "op3_chat_formatting": chat.query,
    "op4_simhash_near_duplicates": simhash.query,
    "op5_quality_rules": quality.query,
    "op6_token_counts": tokens.query,
    "op7_toxicity": toxicity.query,
    "op8_url_rules": urls.query,
    "op9_source_mix": mixing.query,
    "op10_byte_shards": sharding.query,
    "op11_suffix_array_dedup": repeats.query,
    "op12_embedding_whitening": whitening.query,
    "op13_ranked_search": search.query,
}
ORACLES = {
    "op3_chat_formatting": chat.SQL,
    "op5_quality_rules": quality.SQL,
    "op8_url_rules": urls.SQL,
    "op13_ranked_search": search.SQL,
}
