"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tidewell.llm.ann import op6_ann
from tidewell.llm.bpe import op7_bpe
from tidewell.llm.chat import OP9_SQL, op9_chat_format
from tidewell.llm.exact_topk import OP8_SQL, op8_exact_topk
from tidewell.llm.filter_audit import OP13_SQL, op13_filter_audit
from tidewell.llm.near_dedup import op10_near_dedup
from tidewell.llm.packing import op3_packing
from tidewell.llm.pii import op5_pii
from tidewell.llm.quality import op1_quality
from tidewell.llm.repair import OP12_SQL, op12_repair
from tidewell.llm.token_ids import op2_token_ids
from tidewell.llm.toxicity import op4_toxicity
from tidewell.llm.warc import OP11_SQL, op11_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_token_ids": op2_token_ids,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_pii": op5_pii,
    "op6_ann": op6_ann,
    "op7_bpe": op7_bpe,
    "op8_exact_topk": op8_exact_topk,
    "op9_chat_format": op9_chat_format,
    "op10_near_dedup": op10_near_dedup,
    "op11_warc": op11_warc,
    "op12_repair": op12_repair,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL = {"op8_exact_topk": OP8_SQL, "op9_chat_format": OP9_SQL, "op11_warc": OP11_SQL, "op12_repair": OP12_SQL, "op13_filter_audit": OP13_SQL}
