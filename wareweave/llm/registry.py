"""Queries and SQL oracles of the corpus operators."""

from __future__ import annotations

from wareweave.llm import bpe, clustering, exact_dedup, licenses, main_text, merkle, mixing, perplexity, quality_cnn, sharding, simhash, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_perplexity": perplexity.perplexity_query,
        "op2_url_filter": url_filter.url_query,
        "op3_simhash": simhash.simhash_query,
        "op4_toxicity": toxicity.toxicity_query,
        "op5_byte_bpe": bpe.bpe_query,
        "op6_mixing": mixing.mix_query,
        "op7_exact_dedup": exact_dedup.dedup_query,
        "op8_license_scan": licenses.license_query,
        "op9_quality_cnn": quality_cnn.quality_query,
        "op10_sharding": sharding.shard_query,
        "op11_merkle": merkle.merkle_query,
        "op12_clustering": clustering.cluster_query,
        "op13_main_text": main_text.main_text_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_mixing": mixing.MIX_SQL,
        "op7_exact_dedup": exact_dedup.DEDUP_SQL,
        "op11_merkle": merkle.MERKLE_SQL,
        "op12_clustering": clustering.CLUSTER_SQL,
    }
