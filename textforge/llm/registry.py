"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from textforge.llm.byte_bpe import op8_byte_bpe
from textforge.llm.filter_audit import OP12_SQL, op12_filter_audit
from textforge.llm.fingerprint import op2_fingerprint
from textforge.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from textforge.llm.host_rules import OP10_SQL, op10_host_rules
from textforge.llm.jaccard_join import op6_jaccard_join
from textforge.llm.line_dedup import OP13_SQL, op13_line_dedup
from textforge.llm.packing import op4_packing
from textforge.llm.pii import op7_pii
from textforge.llm.sharding import op1_sharding
from textforge.llm.suffix_dedup import op3_suffix_dedup
from textforge.llm.token_store import op5_token_store
from textforge.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_fingerprint": op2_fingerprint,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_packing": op4_packing,
    "op5_token_store": op5_token_store,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_pii": op7_pii,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_host_rules": op10_host_rules,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_line_dedup": op13_line_dedup,
}
ORACLE_SQL: dict[str, str] = {"op10_host_rules": OP10_SQL, "op11_hard_negatives": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_line_dedup": OP13_SQL}
