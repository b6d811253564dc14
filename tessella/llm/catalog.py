"""The queries of this subpackage and the SQL that DuckDB can hold them against."""

from __future__ import annotations

from tessella.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from tessella.llm.html_text import op7_main_text
from tessella.llm.lm_scoring import op8_lm_scores
from tessella.llm.mixing import OP5_SQL, op5_mix_sources
from tessella.llm.ngram_join import OP9_SQL, op9_ngram_join
from tessella.llm.packing import op3_pack
from tessella.llm.quality import op2_quality_pu
from tessella.llm.sharding import OP10_SQL, op10_shard_documents
from tessella.llm.token_counts import op4_token_counts
from tessella.llm.topk import OP1_SQL, op1_top_k

QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_quality_pu": op2_quality_pu,
    "op3_pack": op3_pack,
    "op4_token_counts": op4_token_counts,
    "op5_mix_sources": op5_mix_sources,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_main_text": op7_main_text,
    "op8_lm_scores": op8_lm_scores,
    "op9_ngram_join": op9_ngram_join,
    "op10_shard_documents": op10_shard_documents,
}

ORACLE_SQL = {"op1_top_k": OP1_SQL, "op5_mix_sources": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op9_ngram_join": OP9_SQL, "op10_shard_documents": OP10_SQL}
