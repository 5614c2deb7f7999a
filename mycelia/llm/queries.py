"""The training-data queries and their SQL."""

from __future__ import annotations

from .exact_dedup import OP2_SQL, op2_exact_dedup
from .langid import op3_language_id
from .packing import op1_best_fit_packing
from .piece_sampling import op7_piece_sampling
from .pii import op9_pii
from .quality_rules import OP4_ABLATION_SQL, OP4_SQL, op4_quality_rules, op4_rule_ablation
from .repeats import op10_repeats
from .simhash import op6_simhash
from .token_orc import op5_token_orc
from .toxicity import op8_toxicity

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_orc": op5_token_orc,
    "op6_simhash": op6_simhash,
    "op7_piece_sampling": op7_piece_sampling,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_repeats": op10_repeats,
    "quality_rule_ablation": op4_rule_ablation,
}
ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op4_quality_rules": OP4_SQL, "quality_rule_ablation": OP4_ABLATION_SQL}
