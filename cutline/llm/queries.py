"""The operators' queries by name, and their SQL where SQL can state the result."""

from __future__ import annotations

from cutline.llm import chat, filter_audit
from cutline.llm.chat import op11_chat
from cutline.llm.filter_audit import op12_filter_audit
from cutline.llm.languages import op10_languages
from cutline.llm.lines import op8_lines
from cutline.llm.near import op7_bottom_k
from cutline.llm.outliers import op1_outliers
from cutline.llm.personal import op3_personal
from cutline.llm.pieces import op4_pieces
from cutline.llm.shards import op5_shards
from cutline.llm.suffix_tree import op6_suffix_tree
from cutline.llm.templates import op2_templates
from cutline.llm.token_files import op9_token_files
from cutline.llm.whitening import op13_whitening

QUERIES = {
    "op1_outliers": op1_outliers,
    "op2_templates": op2_templates,
    "op3_personal": op3_personal,
    "op4_pieces": op4_pieces,
    "op5_shards": op5_shards,
    "op6_suffix_tree": op6_suffix_tree,
    "op7_bottom_k": op7_bottom_k,
    "op8_lines": op8_lines,
    "op9_token_files": op9_token_files,
    "op10_languages": op10_languages,
    "op11_chat": op11_chat,
    "op12_filter_audit": op12_filter_audit,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {"op11_chat": chat.SQL, "op12_filter_audit": filter_audit.SQL}
