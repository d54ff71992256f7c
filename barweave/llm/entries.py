"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from barweave.llm import ann, bpe, collocations, exact, jaccard, licenses, merkle, packing, sharding, suffix, toxicity, urls, winnowing

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_suffix_dedup": suffix.op3_suffix_dedup,
    "op4_url_filter": urls.op4_url_filter,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_exact_dedup": exact.op6_exact_dedup,
    "op7_nearest_neighbours": ann.op7_nearest_neighbours,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_sharding": sharding.op9_sharding,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_winnowing": winnowing.op11_winnowing,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES = {
    "op4_url_filter": urls.ORACLE,
    "op5_license_scan": licenses.ORACLE,
    "op6_exact_dedup": exact.ORACLE,
    "op7_nearest_neighbours": ann.ORACLE,
    "op11_winnowing": winnowing.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
