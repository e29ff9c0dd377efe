"""Queries and oracle SQL of the operators in this subpackage."""

from __future__ import annotations

from sparkloom.llm import decontaminate, flac, jaccard, licenses, lines, mixing, substrings, tokenids, toxicity, warc

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_flac": flac.op2_flac,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_token_ids": tokenids.op5_token_ids,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_mixing": mixing.op8_mixing,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_warc": warc.op10_warc,
}
ORACLES = {"op8_mixing": mixing.OP8_SQL, "op10_warc": warc.OP10_SQL}
