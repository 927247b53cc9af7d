"""Registered queries of this subpackage, and the SQL of those that SQL can state."""

from __future__ import annotations

from parchmint.llm import conversations, decontaminate, fingerprint, jaccard, lmscore, mixing, personal, quality, ranking, secrets, sharding, toxicity, urlfilter

QUERIES = {
    "op1_ring_shards": sharding.op1_ring_shards,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_lattice_likelihood": lmscore.op4_lattice_likelihood,
    "op5_secret_scan": secrets.op5_secret_scan,
    "op6_ngram_jaccard": jaccard.op6_ngram_jaccard,
    "op7_chunk_fingerprints": fingerprint.op7_chunk_fingerprints,
    "op8_quality_cotraining": quality.op8_quality_cotraining,
    "op9_url_filter": urlfilter.op9_url_filter,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_ranked_search": ranking.op12_ranked_search,
    "op13_personal_data": personal.op13_personal_data,
}
ORACLES = {
    "op2_source_mix": mixing.OP2_SQL,
    "op6_ngram_jaccard": jaccard.OP6_SQL,
    "op9_url_filter": urlfilter.OP9_SQL,
    "op12_ranked_search": ranking.OP12_SQL,
}
