"""The queries that apply the operators to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from strandline.llm.bpe import op3_bpe
from strandline.llm.id_store import op5_id_store
from strandline.llm.jaccard_join import OP2_SQL, op2_jaccard_join
from strandline.llm.line_dedup import OP1_SQL, op1_line_dedup
from strandline.llm.matroska import OP9_PAYLOAD_SQL, op9_matroska, op9_matroska_payload
from strandline.llm.merkle import OP11_SQL, op11_merkle
from strandline.llm.mixing import OP7_TARGETS_SQL, op7_mixing, op7_mixing_targets
from strandline.llm.piecewise import op13_piecewise
from strandline.llm.pii import OP10_SQL, op10_pii
from strandline.llm.quality_classifier import op8_quality_classifier
from strandline.llm.quality_rules import op4_quality_rules
from strandline.llm.substring_dedup import OP6_SQL, op6_substring_dedup
from strandline.llm.whitening import op12_whitening

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_bpe": op3_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_id_store": op5_id_store,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mixing": op7_mixing,
    "op7_mixing_targets": op7_mixing_targets,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_matroska": op9_matroska,
    "op9_matroska_payload": op9_matroska_payload,
    "op10_pii": op10_pii,
    "op11_merkle": op11_merkle,
    "op12_whitening": op12_whitening,
    "op13_piecewise": op13_piecewise,
}
ORACLE_SQL = {
    "op1_line_dedup": OP1_SQL,
    "op2_jaccard_join": OP2_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op7_mixing_targets": OP7_TARGETS_SQL,
    "op9_matroska_payload": OP9_PAYLOAD_SQL,
    "op10_pii": OP10_SQL,
    "op11_merkle": OP11_SQL,
}
