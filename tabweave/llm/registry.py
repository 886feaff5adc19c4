"""The registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from tabweave.llm import contamination, lines, merkle, mixing, neardup, personal, phrases, quality, secrets, substrings
from tabweave.llm import tokens, toxicity, urls

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_decontaminate": contamination.op2_decontaminate,
    "op3_near_dedup": neardup.op3_near_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_token_binary": tokens.op5_token_binary,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_url_filter": urls.op7_url_filter,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_line_dedup": lines.op9_line_dedup,
    "op10_personal_data": personal.op10_personal_data,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_phrase_mining": phrases.op13_phrase_mining,
}

ORACLES = {
    "op6_mix_sources": mixing.OP6_SQL,
    "op9_line_dedup": lines.OP9_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op13_phrase_mining": phrases.OP13_SQL,
}
