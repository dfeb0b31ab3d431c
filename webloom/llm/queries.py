"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, gif, language, packing, pii, simhash, suffix_tree, token_files, toxicity, tree_bpe

QUERIES = {f.__name__: f for f in (packing.op1_packing, token_files.op2_token_files, tree_bpe.op3_tree_bpe, exact_dedup.op4_exact_dedup, simhash.op5_simhash, toxicity.op6_toxicity, language.op7_language, gif.op8_gif, suffix_tree.op9_suffix_tree, pii.op10_pii)}

ORACLES = {"op4_exact_dedup": exact_dedup.ORACLE}
