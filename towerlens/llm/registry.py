"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from towerlens.llm import decontamination, fixity, hard_negatives, html_main, language_id, license_scan, line_dedup, manifest, packing, pii, quality_rules, sharding, simhash_neardup

QUERIES = {
    "op1_mixture_packing": packing.query,
    "op2_merkle_fixity": fixity.query,
    "op3_pii_weak_labels": pii.query,
    "op4_fm_decontamination": decontamination.query,
    "op5_simhash_vptree": simhash_neardup.query,
    "op6_language_bayes": language_id.query,
    "op7_license_tfidf": license_scan.query,
    "op8_fuzzy_lines": line_dedup.query,
    "op9_best_fit_shards": sharding.query,
    "op10_quality_trees": quality_rules.query,
    "op11_octopus_manifest": manifest.query,
    "op12_host_suffix_array": html_main.query,
    "op13_gnat_negatives": hard_negatives.query,
}
SQL = {"op2_merkle_fixity": fixity.SQL, "op11_octopus_manifest": manifest.SQL, "op13_gnat_negatives": hard_negatives.SQL}
