"""The registered queries of this subpackage and their comparison SQL."""

from __future__ import annotations

from .ann import op6_ann
from .hnsw_dedup import op13_hnsw_dedup
from .lexical import OP12_SQL, op12_lexical_search
from .line_dedup import op5_line_dedup
from .oracles import QUALITY_RULES, SECRET_SCAN
from .pieces import op2_sentencepiece
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality_rules import op7_quality_rules
from .secret_scan import op3_secret_scan
from .simhash_dedup import op9_simhash_dedup
from .source_mix import op4_source_mix
from .token_counts import op10_token_counts
from .url_filter import op8_url_filter
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_secret_scan": op3_secret_scan,
    "op4_source_mix": op4_source_mix,
    "op5_line_dedup": op5_line_dedup,
    "op6_ann": op6_ann,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filter": op8_url_filter,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lexical_search": op12_lexical_search,
    "op13_hnsw_dedup": op13_hnsw_dedup,
}
ORACLES: dict[str, str] = {
    "op1_warc": OP1_SQL, "op3_secret_scan": SECRET_SCAN, "op7_quality_rules": QUALITY_RULES, "op11_prefix_trie": OP11_SQL, "op12_lexical_search": OP12_SQL,
}
