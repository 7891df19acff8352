"""The queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from .bpe import op13_bpe
from .conversations import op12_conversation_repair
from .decontaminate import op4_decontamination
from .html import op5_html_text
from .language import op6_language
from .lines import op1_line_dedup
from .mixing import OP7_SQL, op7_mixing
from .neardup import op10_near_duplicates
from .pii import op9_pii
from .quality import op2_quality
from .ranked import OP11_SQL, op11_ranked_search
from .tokens import op3_token_counts
from .toxicity import op8_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality": op2_quality,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_html_text": op5_html_text,
    "op6_language": op6_language,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_pii": op9_pii,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_ranked_search": op11_ranked_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_bpe": op13_bpe,
}

ORACLE_SQL: dict[str, str] = {"op7_mixing": OP7_SQL, "op11_ranked_search": OP11_SQL}
