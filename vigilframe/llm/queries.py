"""The registered queries of the training-data operators."""

from __future__ import annotations

from .chat import OP8_SQL, op8_chat_prefix_target
from .cross_tokens import op12_cross_tokenizer
from .embeddings import OP5_SQL, op5_embedding_neardup
from .lattice_lm import op4_lattice_lm
from .packing import op2_best_fit_packing
from .quality_lines import op13_quality_lines
from .sentencepiece_codec import op1_sentencepiece
from .simhash import op6_simhash_neardup
from .structure_repair import op11_structure_repair
from .suffix_dedup import op10_suffix_dedup
from .token_counts import op7_edit_aware_counts
from .toxicity import op9_toxicity_crf
from .winnowing import op3_winnowing

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_winnowing": op3_winnowing,
    "op4_lattice_lm": op4_lattice_lm,
    "op5_embedding_neardup": op5_embedding_neardup,
    "op6_simhash_neardup": op6_simhash_neardup,
    "op7_edit_aware_counts": op7_edit_aware_counts,
    "op8_chat_prefix_target": op8_chat_prefix_target,
    "op9_toxicity_crf": op9_toxicity_crf,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_structure_repair": op11_structure_repair,
    "op12_cross_tokenizer": op12_cross_tokenizer,
    "op13_quality_lines": op13_quality_lines,
}
ORACLE_SQL = {"op5_embedding_neardup": OP5_SQL, "op8_chat_prefix_target": OP8_SQL}
