"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from tillscope.llm import bit_packing, chat_windows, context_tree, decontaminate, exact_dedup, filter_audit, html_text, jaccard, lexical_search, line_dedup, packing, quality, token_counts

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_packing": packing.op2_packing,
    "op3_quality": quality.op3_quality,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_context_tree": context_tree.op6_context_tree,
    "op7_html": html_text.op7_html,
    "op8_jaccard_join": jaccard.op8_jaccard_join,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_token_files": bit_packing.op10_token_files,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_chat_windows": chat_windows.op12_chat_windows,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLES = {
    "op4_decontamination": decontaminate.OP4_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op8_jaccard_join": jaccard.OP8_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
