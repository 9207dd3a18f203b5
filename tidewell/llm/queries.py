"""The queries of this folder by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .fertility import op8_fertility
from .jaccard import op5_signature_trees
from .language import op10_language
from .lm import op3_gru_lm
from .neardup_vectors import op9_hyperplane_neardup
from .merkle import OP13_SQL, op13_merkle_manifest
from .mixing import OP7_SQL, op7_pareto_mixing
from .pieces import op6_token_counts
from .packing import op2_cutting_stock
from .repeats import OP12_SQL, op12_suffix_dedup
from .sharding import op4_hypergeometric_shards
from .toxicity import op1_toxicity
from .variants import OP11_SQL, op11_spelling_variants

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_cutting_stock": op2_cutting_stock,
    "op3_gru_lm": op3_gru_lm,
    "op4_hypergeometric_shards": op4_hypergeometric_shards,
    "op5_signature_trees": op5_signature_trees,
    "op6_token_counts": op6_token_counts,
    "op7_pareto_mixing": op7_pareto_mixing,
    "op8_fertility": op8_fertility,
    "op9_hyperplane_neardup": op9_hyperplane_neardup,
    "op10_language": op10_language,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLES = {"op7_pareto_mixing": OP7_SQL, "op11_spelling_variants": OP11_SQL, "op12_suffix_dedup": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
