"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import oracles
from .chat import op10
from .decontaminate import op5
from .embeddings import op3
from .importance import op13
from .language import op7
from .licenses import op6
from .lines import op12
from .minhash import op2
from .pieces import op4
from .quality import op8
from .suffixes import op1
from .toxicity import op9
from .whitening import op11

QUERIES = {
    "op1_suffix_dedup": op1,
    "op2_minhash_near_dedup": op2,
    "op3_embedding_near_dedup": op3,
    "op4_sentencepiece": op4,
    "op5_decontamination": op5,
    "op6_license_scan": op6,
    "op7_language_id": op7,
    "op8_quality": op8,
    "op9_toxicity": op9,
    "op10_chat_format": op10,
    "op11_embedding_whitening": op11,
    "op12_line_dedup": op12,
    "op13_importance_resampling": op13,
}
SQL = {
    "op1_suffix_dedup": oracles.OP1,
    "op2_minhash_near_dedup": oracles.OP2,
    "op3_embedding_near_dedup": oracles.OP3,
    "op6_license_scan": oracles.op6(),
    "op10_chat_format": oracles.OP10,
    "op12_line_dedup": oracles.OP12,
}
