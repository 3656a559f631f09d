"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, byte_bpe, class_lm, cover_tree, near_dup, packing, periodic, prefix_trie, quality_knn, quality_rules, suffix_dedup, toxicity, url_filter
from .common import bound_batches

def _bounded(query):
    def run(spark, sf_dir):
        bound_batches(spark)
        return query(spark, sf_dir)

    run.__doc__ = query.__doc__
    return run


_QUERIES = {
    "op1_topk_search": cover_tree.op1_topk_search,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_minhash_dedup": near_dup.op3_minhash_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_bpe": bpe.op5_bpe,
    "op6_quality_knn": quality_knn.op6_quality_knn,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_class_lm": class_lm.op8_class_lm,
    "op9_packing": packing.op9_packing,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_byte_bpe": byte_bpe.op12_byte_bpe,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

QUERIES = {name: _bounded(query) for name, query in _QUERIES.items()}

#: The others hash, learn or walk texts in ways that SQL can't express, or
#: can't on whole tables; tests hold them against brute force.
ORACLE_SQL = {
    "op1_topk_search": cover_tree.ORACLE,
    "op2_url_filter": url_filter.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
}
