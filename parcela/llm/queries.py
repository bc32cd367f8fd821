"""The subpackage's registered queries, and their SQL twins."""

from __future__ import annotations

from parcela.llm.bpe import op8_bpe_codec
from parcela.llm.html_text import op3_html_text
from parcela.llm.jaccard import OP5_SQL, op5_jaccard_join
from parcela.llm.line_dedup import OP1_SQL, op1_line_dedup
from parcela.llm.line_rules import op10_line_rules
from parcela.llm.packing import op6_packing
from parcela.llm.pitman_yor import op11_pitman_yor
from parcela.llm.product_codes import OP12_SQL, op12_product_codes
from parcela.llm.qda import op9_qda_quality
from parcela.llm.resample import op13_importance_resample
from parcela.llm.tokencount import op7_token_counts
from parcela.llm.topk import OP2_SQL, op2_topk
from parcela.llm.warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_topk": op2_topk,
    "op3_html_text": op3_html_text,
    "op4_warc": op4_warc,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_packing": op6_packing,
    "op7_token_counts": op7_token_counts,
    "op8_bpe_codec": op8_bpe_codec,
    "op9_qda_quality": op9_qda_quality,
    "op10_line_rules": op10_line_rules,
    "op11_pitman_yor": op11_pitman_yor,
    "op12_product_codes": op12_product_codes,
    "op13_importance_resample": op13_importance_resample,
}

SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op2_topk": OP2_SQL,
    "op4_warc": OP4_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op12_product_codes": OP12_SQL,
}
