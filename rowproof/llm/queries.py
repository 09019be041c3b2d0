"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from rowproof.llm import bpe, cover_tree, html_text, line_runs, minhash, mixing, multi_index, periodic, run_length, secret_scan, spelling, token_files, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_run_length": run_length.op2_run_length,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_cover_tree": cover_tree.op4_cover_tree,
    "op5_token_files": token_files.op5_token_files,
    "op6_minhash": minhash.op6_minhash,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_html_text": html_text.op8_html_text,
    "op9_multi_index": multi_index.op9_multi_index,
    "op10_bpe_words": bpe.op10_bpe_words,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_line_runs": line_runs.op13_line_runs,
}
#: The others are not for SQL: their tests compare them with brute force, round trips or held-out labels.
SQL = {"op3_mix_sources": mixing.OP3_SQL, "op13_line_runs": line_runs.OP13_SQL}
