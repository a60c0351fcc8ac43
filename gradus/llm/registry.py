"""Queries of the corpus operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

from gradus.llm.bpe import op6_bpe
from gradus.llm.exact_dedup import OP5_SQL, op5_exact_dedup
from gradus.llm.lexical_search import OP12_SQL, op12_ranked_search
from gradus.llm.line_dedup import OP7_SQL, op7_line_dedup
from gradus.llm.media_jpeg import op1_media_jpeg
from gradus.llm.merkle import OP11_SQL, op11_merkle_manifest
from gradus.llm.mixing import OP2_SQL, op2_mixing
from gradus.llm.pii import op9_pii
from gradus.llm.quality_cnn import op3_quality_cnn
from gradus.llm.simhash_dedup import op10_simhash_dedup
from gradus.llm.token_store import op4_token_store
from gradus.llm.toxicity_crf import op8_toxicity_crf
from gradus.llm.vector_topk import OP13_SQL, op13_vector_topk

QUERIES = {
    "op1_media_jpeg": op1_media_jpeg,
    "op2_mixing": op2_mixing,
    "op3_quality_cnn": op3_quality_cnn,
    "op4_token_store": op4_token_store,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_bpe": op6_bpe,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity_crf": op8_toxicity_crf,
    "op9_pii": op9_pii,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_ranked_search": op12_ranked_search,
    "op13_vector_topk": op13_vector_topk,
}

QUERY_SQL = {
    "op2_mixing": OP2_SQL,
    "op5_exact_dedup": OP5_SQL,
    "op7_line_dedup": OP7_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_vector_topk": OP13_SQL,
}
