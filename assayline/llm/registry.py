"""Queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from assayline.llm import (bloom_dedup, bpe_words, conversation_trie, license_scan, ngram_join,
                           packing, rp_forest, sharding, spelling_variants, suffix_dedup,
                           toxicity_grammar, unigram_count, url_reputation)

QUERIES = {f.__name__: f for f in (
    sharding.op1_prefix_sum_shards, suffix_dedup.op2_suffix_array_dedup,
    url_reputation.op3_host_reputation, ngram_join.op4_vertical_jaccard_join,
    packing.op5_hierarchical_best_fit, bpe_words.op6_distinct_word_bpe,
    bloom_dedup.op7_bloom_exact_dedup,
    unigram_count.op8_unigram_token_counts, rp_forest.op9_rp_forest_near_dedup,
    toxicity_grammar.op10_toxicity_grammar, license_scan.op11_rare_token_licenses,
    spelling_variants.op12_chunk_spelling_variants,
    conversation_trie.op13_conversation_trie)}
ORACLES = {"op3_host_reputation": url_reputation.SQL, "op7_bloom_exact_dedup": bloom_dedup.SQL,
           "op9_rp_forest_near_dedup": rp_forest.SQL,
           "op11_rare_token_licenses": license_scan.SQL,
           "op12_chunk_spelling_variants": spelling_variants.SQL,
           "op13_conversation_trie": conversation_trie.SQL}
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
