"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from . import epsilon_grid, licenses, line_runs, vector_codes, warc
from .bpe_trie import op6_trie_bpe
from .common import tidy
from .packing import op10_best_two_fit
from .quality import op9_ngram_perplexity
from .sharding import op5_label_propagation
from .token_files import op8_token_files
from .weighted_minhash import op7_weighted_minhash
from .whitening import op12_tiled_whitening
from .wrappers import op1_wrapper_extraction

QUERIES = {
    "op1_wrapper_extraction": op1_wrapper_extraction,
    "op2_epsilon_grid": epsilon_grid.op2_epsilon_grid,
    "op3_warc_transactions": warc.op3_warc_transactions,
    "op4_line_runs": line_runs.op4_line_runs,
    "op5_label_propagation": op5_label_propagation,
    "op6_trie_bpe": op6_trie_bpe,
    "op7_weighted_minhash": op7_weighted_minhash,
    "op8_token_files": op8_token_files,
    "op9_ngram_perplexity": op9_ngram_perplexity,
    "op10_best_two_fit": op10_best_two_fit,
    "op11_elkan_codes": vector_codes.op11_elkan_codes,
    "op12_tiled_whitening": op12_tiled_whitening,
    "op13_diagonal_licenses": licenses.op13_diagonal_licenses,
}

QUERIES = {name: tidy(f) for name, f in QUERIES.items()}

ORACLES: dict[str, str] = {
    "op2_epsilon_grid": epsilon_grid.ORACLE,
    "op3_warc_transactions": warc.ORACLE,
    "op4_line_runs": line_runs.ORACLE,
    "op11_elkan_codes": vector_codes.ORACLE,
    "op13_diagonal_licenses": licenses.ORACLE,
}
