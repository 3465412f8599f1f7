"""The registered queries of the numbered operators, and their SQL where there is one."""

from __future__ import annotations

from concord.llm import divergence, line_dedup, quality_rules
from concord.llm.bpe import op12
from concord.llm.byte_dedup import op9
from concord.llm.decontaminate import op5
from concord.llm.divergence import op11
from concord.llm.language_id import op1
from concord.llm.language_model import op6
from concord.llm.line_dedup import op3
from concord.llm.near_duplicates import op4
from concord.llm.packing import op10
from concord.llm.periodic_runs import op13
from concord.llm.quality_model import op8
from concord.llm.quality_rules import op7
from concord.llm.secrets import op2

QUERIES = {
    "op1_language_id": op1,
    "op2_secrets": op2,
    "op3_line_dedup": op3,
    "op4_near_duplicates": op4,
    "op5_decontaminate": op5,
    "op6_language_model": op6,
    "op7_quality_rules": op7,
    "op8_quality_model": op8,
    "op9_byte_dedup": op9,
    "op10_packing": op10,
    "op11_source_divergence": op11,
    "op12_byte_bpe": op12,
    "op13_periodic_runs": op13,
}

ORACLE_SQL = {"op11_source_divergence": divergence.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op7_quality_rules": quality_rules.ORACLE}
