"""Queries and oracle SQL of this subpackage, as the driver's entry module adds them."""

from __future__ import annotations

from querylens.llm.alignment import op13_alignment
from querylens.llm.divergence import OP11_SQL, op11_divergence
from querylens.llm.language import op8_language
from querylens.llm.lz_fingerprint import op7_lz_fingerprint
from querylens.llm.mixing import OP1_SQL, op1_mixing
from querylens.llm.packing import op9_packing
from querylens.llm.quality import op3_quality
from querylens.llm.secrets import OP12_SQL, op12_secrets
from querylens.llm.sharding import OP5_SQL, op5_sharding
from querylens.llm.simhash import op6_simhash
from querylens.llm.suffix_dedup import op2_suffix_dedup
from querylens.llm.suffix_tree_lm import op4_suffix_tree_lm
from querylens.llm.url_rules import OP10_SQL, op10_url_rules

QUERIES = {"op1_mixing": op1_mixing, "op2_suffix_dedup": op2_suffix_dedup, "op3_quality": op3_quality, "op4_suffix_tree_lm": op4_suffix_tree_lm, "op5_sharding": op5_sharding, "op6_simhash": op6_simhash, "op7_lz_fingerprint": op7_lz_fingerprint, "op8_language": op8_language, "op9_packing": op9_packing, "op10_url_rules": op10_url_rules, "op11_divergence": op11_divergence, "op12_secrets": op12_secrets, "op13_alignment": op13_alignment}
ORACLES = {"op1_mixing": OP1_SQL, "op5_sharding": OP5_SQL, "op10_url_rules": OP10_SQL, "op11_divergence": OP11_SQL, "op12_secrets": OP12_SQL}
