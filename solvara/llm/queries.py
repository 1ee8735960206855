"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from solvara.llm.contamination import OP5_SQL, op5_decontamination
from solvara.llm.html_text import op2_html_text
from solvara.llm.knn import OP8_SQL, op8_knn_join
from solvara.llm.lexical import OP13_SQL, op13_lexical_search
from solvara.llm.licences import OP4_SQL, op4_licence_scan
from solvara.llm.line_dedup import OP11_SQL, op11_line_dedup
from solvara.llm.near_dups import OP6_SQL, op6_near_dups
from solvara.llm.packing import op10_packing
from solvara.llm.quality import op9_quality
from solvara.llm.sharding import OP3_SQL, op3_feistel_shards
from solvara.llm.substrings import OP7_SQL, op7_substring_dedup
from solvara.llm.token_files import op1_token_files
from solvara.llm.whitening import op12_whitening

QUERIES = {f.__name__: f for f in (op1_token_files, op2_html_text, op3_feistel_shards, op4_licence_scan, op5_decontamination, op6_near_dups, op7_substring_dedup, op8_knn_join, op9_quality, op10_packing, op11_line_dedup, op12_whitening, op13_lexical_search)}

ORACLE_SQL: dict[str, str] = {"op3_feistel_shards": OP3_SQL, "op4_licence_scan": OP4_SQL, "op5_decontamination": OP5_SQL, "op6_near_dups": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op8_knn_join": OP8_SQL, "op11_line_dedup": OP11_SQL, "op13_lexical_search": OP13_SQL}
