"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, centroids, exact_dedup, language_id, lattice_dedup, license_scan, mixing, pii, quality_model, quality_rules, simhash, spelling_variants, substring_dedup

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_simhash": simhash.op2_simhash,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_pii": pii.op5_pii,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_quality_model": quality_model.op10_quality_model,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_centroids": centroids.op12_centroids,
    "op13_lattice_dedup": lattice_dedup.op13_lattice_dedup,
}

ORACLES = {"op3_exact_dedup": exact_dedup.ORACLE, "op8_substring_dedup": substring_dedup.ORACLE}
