"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from evidencelake.llm import chosen_path, decontamination, fp_search, license_scan, quality_rules, url_filters
from evidencelake.llm.alignment import op11_alignment
from evidencelake.llm.bloom_lm import op12_bloom_lm
from evidencelake.llm.chosen_path import op3_chosen_path_join
from evidencelake.llm.decontamination import op10_decontamination
from evidencelake.llm.fp_search import op13_fp_search
from evidencelake.llm.language_id import op6_language_id
from evidencelake.llm.license_scan import op1_license_scan
from evidencelake.llm.prefix_bpe import op9_prefix_bpe
from evidencelake.llm.quality_rules import op2_quality_rules
from evidencelake.llm.rule_ensemble import op5_rule_ensemble
from evidencelake.llm.token_files import op8_token_files
from evidencelake.llm.url_filters import op7_url_filters
from evidencelake.llm.warc_derivatives import op4_warc_derivatives

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "op3_chosen_path_join": op3_chosen_path_join,
    "op4_warc_derivatives": op4_warc_derivatives,
    "op5_rule_ensemble": op5_rule_ensemble,
    "op6_language_id": op6_language_id,
    "op9_prefix_bpe": op9_prefix_bpe,
    "op7_url_filters": op7_url_filters,
    "op8_token_files": op8_token_files,
    "op10_decontamination": op10_decontamination,
    "op11_alignment": op11_alignment,
    "op12_bloom_lm": op12_bloom_lm,
    "op13_fp_search": op13_fp_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": license_scan.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op3_chosen_path_join": chosen_path.ORACLE,
    "op7_url_filters": url_filters.ORACLE,
    "op10_decontamination": decontamination.ORACLE,
    "op13_fp_search": fp_search.ORACLE,
}
