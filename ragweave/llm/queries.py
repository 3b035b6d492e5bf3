"""Queries of the corpus operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, decontam, jaccard, licenses, linerules, negatives, ngram_lm, packing, quality, repeats, secrets_scan, simhash, urlfilter

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_decontaminate": decontam.op2_decontaminate,
    "op3_lm_score": ngram_lm.op3_lm_score,
    "op4_licenses": licenses.op4_licenses,
    "op5_pack": packing.op5_pack,
    "op6_url_filter": urlfilter.op6_url_filter,
    "op7_quality": quality.op7_quality,
    "op8_secrets": secrets_scan.op8_secrets,
    "op9_repeats": repeats.op9_repeats,
    "op10_line_rules": linerules.op10_line_rules,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_jaccard_join": jaccard.op13_jaccard_join,
}

ORACLE_SQL = {"op2_decontaminate": decontam.SQL, "op6_url_filter": urlfilter.SQL, "op10_line_rules": linerules.SQL, "op12_hard_negatives": negatives.SQL, "op13_jaccard_join": jaccard.SQL}
