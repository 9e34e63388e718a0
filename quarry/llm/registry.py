"""Queries of the training-data operators, and the SQL that holds where SQL can say it."""

from __future__ import annotations

from .ann import op4_ann
from .bpe import op10_bpe
from .chat import op6_chat
from .divergence import OP12_SQL, op12_divergence
from .exact_dedup import OP2_SQL, op2_exact_dedup
from .html_extract import op5_html
from .minhash import OP1_SQL, op1_minhash
from .packing import op9_packing
from .quality import op11_quality
from .sharding import OP8_SQL, op8_sharding
from .suffix_dedup import op3_suffix_dedup
from .toxicity import op7_toxicity
from .vector_codes import OP13_SQL, op13_vector_codes

QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ann": op4_ann,
    "op5_html": op5_html,
    "op6_chat": op6_chat,
    "op7_toxicity": op7_toxicity,
    "op8_sharding": op8_sharding,
    "op9_packing": op9_packing,
    "op10_bpe": op10_bpe,
    "op11_quality": op11_quality,
    "op12_divergence": op12_divergence,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL = {
    "op1_minhash": OP1_SQL,
    "op2_exact_dedup": OP2_SQL,
    "op8_sharding": OP8_SQL,
    "op12_divergence": OP12_SQL,
    "op13_vector_codes": OP13_SQL,
}
