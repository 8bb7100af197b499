"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from leafquarry.llm.ball_tree import OP13_SQL, op13_ball_tree
from leafquarry.llm.bpe import op6_bpe
from leafquarry.llm.exact_dedup import OP3_SQL, op3_exact_dedup
from leafquarry.llm.html_text import op8_html
from leafquarry.llm.jpeg import op10_jpeg
from leafquarry.llm.mixing import OP2_SQL, op2_mixing
from leafquarry.llm.multiset_hash import OP12_SQL, op12_multiset_hash
from leafquarry.llm.ngram_lm import op7_language_model
from leafquarry.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from leafquarry.llm.quality import op5_quality
from leafquarry.llm.secrets import op4_secrets
from leafquarry.llm.simhash import op9_simhash
from leafquarry.llm.toxicity import op1_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_mixing, op3_exact_dedup, op4_secrets, op5_quality, op6_bpe, op7_language_model, op8_html, op9_simhash, op10_jpeg,
        op11_prefix_trie, op12_multiset_hash, op13_ball_tree,
    )
}

ORACLE_SQL = {
    "op2_mixing": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op11_prefix_trie": OP11_SQL, "op12_multiset_hash": OP12_SQL, "op13_ball_tree": OP13_SQL,
}
