"""The corpus operators' queries by name, with DuckDB twins where SQL can express them."""

from __future__ import annotations

from parlance.llm import centroid_clustering, decontamination, exact_topk, jaccard_join, language_id, phrase_mining, secret_scan, source_mixing, suffix_array_dedup, suffix_tree_dedup, toxicity, url_filter, warc_revisit

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_suffix_array_dedup": suffix_array_dedup.op2_suffix_array_dedup,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_warc_revisit": warc_revisit.op4_warc_revisit,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_ngram_jaccard_join": jaccard_join.op6_ngram_jaccard_join,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_source_mixing": source_mixing.op8_source_mixing,
    "op9_exact_topk": exact_topk.op9_exact_topk,
    "op10_suffix_tree_dedup": suffix_tree_dedup.op10_suffix_tree_dedup,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_centroid_clustering": centroid_clustering.op12_centroid_clustering,
    "op13_phrase_mining": phrase_mining.op13_phrase_mining,
}
ORACLE_SQL: dict[str, str] = {
    "op4_warc_revisit": warc_revisit.ORACLE_SQL,
    "op8_source_mixing": source_mixing.ORACLE_SQL,
    "op9_exact_topk": exact_topk.ORACLE_SQL,
    "op12_centroid_clustering": centroid_clustering.ORACLE_SQL,
    "op13_phrase_mining": phrase_mining.ORACLE_SQL,
}
