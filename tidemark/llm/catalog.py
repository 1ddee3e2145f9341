"""The registered queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from tidemark.llm import filter_audit, line_winnow, quality_llr, va_file
from tidemark.llm.bin_packing import op10_best_fit
from tidemark.llm.byte_bpe import op2_byte_bpe
from tidemark.llm.filter_audit import op11_filter_audit
from tidemark.llm.langid_ftrl import op5_langid_ftrl
from tidemark.llm.line_winnow import op4_line_winnow
from tidemark.llm.paragraph_minhash import op8_paragraph_minhash
from tidemark.llm.periodic_runs import op13_periodic_runs
from tidemark.llm.pii_bilstm import op12_pii_bilstm
from tidemark.llm.quality_llr import op1_quality_llr
from tidemark.llm.superminhash import op7_superminhash
from tidemark.llm.token_spans import op9_token_spans
from tidemark.llm.toxicity_zstd import op6_toxicity_zstd
from tidemark.llm.va_file import op3_va_file

QUERIES = {f.__name__: f for f in (op1_quality_llr, op2_byte_bpe, op3_va_file, op4_line_winnow, op5_langid_ftrl, op6_toxicity_zstd, op7_superminhash, op8_paragraph_minhash, op9_token_spans, op10_best_fit,
                                      op11_filter_audit, op12_pii_bilstm, op13_periodic_runs)}
ORACLES: dict[str, str] = {"op1_quality_llr": quality_llr.ORACLE, "op3_va_file": va_file.ORACLE, "op4_line_winnow": line_winnow.ORACLE,
                           "op11_filter_audit": filter_audit.ORACLE}
