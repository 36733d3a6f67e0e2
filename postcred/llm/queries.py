"""The subpackage's registered queries and their DuckDB twins."""

from __future__ import annotations

from postcred.llm.chat import OP13_SQL, op13_chat_formatting
from postcred.llm.collocations import OP11_SQL, op11_phrase_collocations
from postcred.llm.decontaminate import OP4_SQL, op4_decontaminate
from postcred.llm.html import op1_html_extraction
from postcred.llm.lattice import op8_lm_scoring
from postcred.llm.lines import OP5_SQL, op5_line_dedup
from postcred.llm.packing import op9_packing
from postcred.llm.quality import op6_quality_rules
from postcred.llm.secrets import op7_secret_scans
from postcred.llm.simhash import op2_simhash_near_dedup
from postcred.llm.toxicity import op10_toxicity
from postcred.llm.warc import OP3_SQL, op3_warc
from postcred.llm.whitening import op12_embedding_whitening

QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_simhash_near_dedup, op3_warc, op4_decontaminate, op5_line_dedup,
                                   op6_quality_rules, op7_secret_scans, op8_lm_scoring, op9_packing, op10_toxicity,
                                   op11_phrase_collocations, op12_embedding_whitening, op13_chat_formatting)}
SQL = {"op3_warc": OP3_SQL, "op4_decontaminate": OP4_SQL, "op5_line_dedup": OP5_SQL, "op11_phrase_collocations": OP11_SQL, "op13_chat_formatting": OP13_SQL}
