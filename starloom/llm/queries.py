"""The queries of the operators, and SQL for those that it can express."""

from __future__ import annotations

from starloom.llm import decontaminate, hmm_lm, license_scan, line_dedup, packing, quality_gam, quality_rules, quote_links, sharding, simhash

QUERIES = {
    "op1_quote_links": quote_links.op1_quote_links,
    "op2_sharding": sharding.op2_sharding,
    "op3_simhash": simhash.op3_simhash,
    "op4_quality_gam": quality_gam.op4_quality_gam,
    "op5_hmm_lm": hmm_lm.op5_hmm_lm,
    "op6_packing": packing.op6_packing,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_decontamination": decontaminate.op9_decontamination,
    "op10_license_scan": license_scan.op10_license_scan,
}

ORACLE_SQL = {
    "op1_quote_links": quote_links.OP1_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
}
