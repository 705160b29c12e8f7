"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import centroids, chat, divergence, hamming, jaccard, licenses, mixing, packing, quality, sharding, simhash, suffixes, tokens


def queries():
    return {
        "op1_top_k_search": hamming.query,
        "op2_mixing": mixing.query,
        "op3_token_counts": tokens.query,
        "op4_license_scan": licenses.query,
        "op5_simhash_dedup": simhash.query,
        "op6_suffix_array_dedup": suffixes.query,
        "op7_packing": packing.query,
        "op8_chat_formatting": chat.query,
        "op9_quality_rules": quality.query,
        "op10_sharding": sharding.query,
        "op11_source_divergence": divergence.query,
        "op12_jaccard_join": jaccard.query,
        "op13_centroid_clustering": centroids.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_top_k_search": hamming.ORACLE,
        "op8_chat_formatting": chat.ORACLE,
        "op11_source_divergence": divergence.ORACLE,
        "op12_jaccard_join": jaccard.ORACLE,
        "op13_centroid_clustering": centroids.ORACLE,
    }
