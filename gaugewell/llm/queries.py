"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, exact_dedup, knn, language, licenses, line_dedup, mixing, secrets, simhash, substring_dedup

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_secrets": secrets.op2_secrets,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_language": language.op5_language,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_top_k": knn.op7_top_k,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_licenses": licenses.op9_licenses,
    "op10_simhash": simhash.op10_simhash,
}
ORACLES = {"op4_line_dedup": line_dedup.SQL, "op7_top_k": knn.SQL, "op8_exact_dedup": exact_dedup.SQL}
