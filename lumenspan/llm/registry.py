"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from lumenspan.session import shipped

from .byte_bpe import op12_byte_bpe
from .decontaminate import op10_leaks
from .fill_middle import SQL_OP13, op13_fill_middle
from .filter_audit import SQL_OP11, op11_filter_audit
from .html_text import op8_main_text
from .lm_scoring import op7_lm_scores
from .mixing import SQL_OP6, op6_mix
from .quality_classifier import op5_quality
from .quality_rules import SQL_OP3, op3_quality_rules
from .secrets import SQL_OP1, op1_secrets
from .simhash import op9_simhash
from .token_output import op2_token_order
from .urls import SQL_OP4, op4_url_filter

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_token_order": shipped(op2_token_order),
    "op3_quality_rules": shipped(op3_quality_rules),
    "op4_url_filter": op4_url_filter,
    "op5_quality": shipped(op5_quality),
    "op6_mix": op6_mix,
    "op7_lm_scores": shipped(op7_lm_scores),
    "op8_main_text": shipped(op8_main_text),
    "op9_simhash": shipped(op9_simhash),
    "op10_leaks": shipped(op10_leaks),
    "op11_filter_audit": shipped(op11_filter_audit),
    "op12_byte_bpe": shipped(op12_byte_bpe),
    "op13_fill_middle": op13_fill_middle,
}
ORACLE_SQL = {"op1_secrets": SQL_OP1, "op3_quality_rules": SQL_OP3, "op4_url_filter": SQL_OP4, "op6_mix": SQL_OP6, "op11_filter_audit": SQL_OP11, "op13_fill_middle": SQL_OP13}
