"""The registered queries of this package and the SQL that DuckDB can run for them."""

from __future__ import annotations

from . import (audit, chat, exact_dedup, extraction, fingerprints, language, near_duplicates, neighbours, ngram_trie, oracle,
               packing, quality, sentencepieces, spelling)

QUERIES = {
    "op1_sentencepiece": sentencepieces.op1_sentencepiece,
    "op2_learned_partitions": neighbours.op2_learned_partitions,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_iblt_fingerprints": fingerprints.op5_iblt_fingerprints,
    "op6_html_extraction": extraction.op6_html_extraction,
    "op7_language_id": language.op7_language_id,
    "op8_minhash_near_duplicates": near_duplicates.op8_minhash_near_duplicates,
    "op9_elias_fano_lm": ngram_trie.op9_elias_fano_lm,
    "op10_reply_trees": chat.op10_reply_trees,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_filter_audit": audit.op12_filter_audit,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}
#: Where trained models, hashed signatures or check sums that SQL lacks decide, or SQL is too slow on whole tables, the query is
#: tested against brute force, an exact round trip or held-out accuracy instead.
ORACLE: dict[str, str] = {
    "op8_minhash_near_duplicates": oracle.NEAR_DUPLICATES,
    "op10_reply_trees": oracle.REPLY_TREES,
    "op12_filter_audit": audit.ORACLE_SQL,
    "op13_exact_dedup": exact_dedup.ORACLE_SQL,
}
