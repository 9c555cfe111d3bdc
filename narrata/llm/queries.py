"""The registered queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op3_bpe
from .conversations import OP13_SQL, op13_conversations
from .embeddings import op6_embeddings
from .fingerprints import op1_fingerprints
from .licenses import op4_licenses
from .mixing import OP9_SQL, op9_mixing
from .negatives import OP11_SQL, op11_negatives
from .quality import op10_quality
from .secrets import op5_secrets
from .simhash import op8_simhash
from .substrings import op7_substrings
from .toxicity import op2_toxicity
from .warc import OP12_SQL, op12_warc

QUERIES = {
    "op7_substrings": op7_substrings,
    "op6_embeddings": op6_embeddings,
    "op2_toxicity": op2_toxicity,
    "op10_quality": op10_quality,
    "op3_bpe": op3_bpe,
    "op8_simhash": op8_simhash,
    "op1_fingerprints": op1_fingerprints,
    "op4_licenses": op4_licenses,
    "op5_secrets": op5_secrets,
    "op9_mixing": op9_mixing,
    "op11_negatives": op11_negatives,
    "op12_warc": op12_warc,
    "op13_conversations": op13_conversations,
}

ORACLE_SQL = {
    "op9_mixing": OP9_SQL,
    "op11_negatives": OP11_SQL,
    "op12_warc": OP12_SQL,
    "op13_conversations": OP13_SQL,
}
