"""The registered queries of this package: name -> (query, SQL or None)."""

from __future__ import annotations

from corpusloom.llm import block_anchors, byte_bpe, decontaminate, language_id, license_scan, merkle, periodic_runs, pseudonyms, quality_rules, secret_scan, set_join, shard_tree, url_filter

QUERIES = {
    "op1_url_language_model": (url_filter.op1_url_language_model, None),
    "op2_chosen_path_join": (set_join.op2_chosen_path_join, None),
    "op3_spaced_seeds": (decontaminate.op3_spaced_seeds, None),
    "op4_language_hierarchy": (language_id.op4_language_hierarchy, None),
    "op5_block_anchors": (block_anchors.op5_block_anchors, None),
    "op6_license_diagonals": (license_scan.op6_license_diagonals, None),
    "op7_feistel_pseudonyms": (pseudonyms.op7_feistel_pseudonyms, None),
    "op8_byte_bpe": (byte_bpe.op8_byte_bpe, None),
    "op9_weighted_hash_tree": (shard_tree.op9_weighted_hash_tree, shard_tree.ORACLE_SQL),
    "op10_quality_rules": (quality_rules.op10_quality_rules, quality_rules.ORACLE_SQL),
    "op11_secret_models": (secret_scan.op11_secret_models, None),
    "op12_periodic_runs": (periodic_runs.op12_periodic_runs, None),
    "op13_merkle_proofs": (merkle.op13_merkle_proofs, merkle.ORACLE_SQL),
}
