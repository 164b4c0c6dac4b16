"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from .blockmax import OP13_SQL, op13_block_max
from .decontamination import OP11_SQL, op11_decontamination
from .dedup import OP8_SQL, op8_exact_dedup
from .jaccard import op4_jaccard_join
from .katz import op6_katz
from .licences import op5_licences
from .maxscore import OP10_SQL, op10_maxscore_topk
from .mixing import OP1_SQL, op1_mixing
from .packing import op7_packing
from .sharding import op3_sharding
from .token_counts import op9_token_counts
from .toxicity import op2_toxicity
from .vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_licences": op5_licences,
    "op6_katz": op6_katz,
    "op7_packing": op7_packing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_maxscore_topk": op10_maxscore_topk,
    "op11_decontamination": op11_decontamination,
    "op12_vector_codes": op12_vector_codes,
    "op13_block_max": op13_block_max,
}
ORACLES = {
    "op1_mixing": OP1_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op10_maxscore_topk": OP10_SQL,
    "op11_decontamination": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_block_max": OP13_SQL,
}
