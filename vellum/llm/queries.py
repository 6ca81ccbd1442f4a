"""The queries of this subpackage, by name. Each applies its operator to its whole table."""

from __future__ import annotations

from vellum.llm import decontamination, license_scan, line_dedup, mixing, near_dedup, perplexity, quality_rules, secret_scan, sharding, suffix_dedup
from vellum.llm.oracles import ORACLES  # noqa: F401  the catalogue of this subpackage

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_bagminhash_dedup": near_dedup.query,
    "op3_run_length_index": suffix_dedup.query,
    "op4_pareto_mix": mixing.query,
    "op5_kneser_ney": perplexity.query,
    "op6_linked_secrets": secret_scan.query,
    "op7_line_chunks": line_dedup.query,
    "op8_license_diagonals": license_scan.query,
    "op9_bounded_ring": sharding.query,
    "op10_isolation_rules": quality_rules.query,
    # columns of op8 and op10 that SQL can express
    "license_phrases": lambda spark, sf_dir: license_scan.query(spark, sf_dir).drop("labels", "score"),
    "rule_counts": quality_rules.counts_query,
}
