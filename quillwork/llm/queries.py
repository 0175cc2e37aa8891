"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from quillwork.llm import block_kmeans, chat_snapshots, lexical_search, revisits, url_trust
from quillwork.llm.block_kmeans import op13_block_kmeans
from quillwork.llm.bpe_tree import op4_byte_bpe
from quillwork.llm.chat_snapshots import op10_snapshot_collapse
from quillwork.llm.decontam import op7_benchmark_ngrams
from quillwork.llm.divergence import op5_distribution_divergence
from quillwork.llm.html_templates import op11_template_extraction
from quillwork.llm.lexical_search import op12_tput_search
from quillwork.llm.line_dedup import op6_fuzzy_lines
from quillwork.llm.pairwise_quality import op3_bradley_terry
from quillwork.llm.revisits import op9_revisit_asof
from quillwork.llm.simhash import op8_simhash_pigeonring
from quillwork.llm.surrogates import op2_surrogates
from quillwork.llm.url_trust import op1_link_trust

QUERIES = {
    "op1_link_trust": op1_link_trust,
    "op2_surrogates": op2_surrogates,
    "op3_bradley_terry": op3_bradley_terry,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_distribution_divergence": op5_distribution_divergence,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_benchmark_ngrams": op7_benchmark_ngrams,
    "op8_simhash_pigeonring": op8_simhash_pigeonring,
    "op9_revisit_asof": op9_revisit_asof,
    "op10_snapshot_collapse": op10_snapshot_collapse,
    "op11_template_extraction": op11_template_extraction,
    "op12_tput_search": op12_tput_search,
    "op13_block_kmeans": op13_block_kmeans,
}
ORACLES = {
    "op1_link_trust": url_trust.ORACLE,
    "op9_revisit_asof": revisits.ORACLE,
    "op10_snapshot_collapse": chat_snapshots.ORACLE,
    "op12_tput_search": lexical_search.ORACLE,
    "op13_block_kmeans": block_kmeans.ORACLE,
}
