"""The queries of this subpackage by name, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from payflux.llm import chat, embedding_dedup, jaccard, neighbours, quality, secrets, substring_dedup
from payflux.llm.collocations import OP12_SQL, op12_phrase_collocations
from payflux.llm.exact_dedup import OP13_SQL, op13_exact_dedup
from payflux.llm.mixing import OP10_SQL, op10_mixing
from payflux.llm.packing import OP5_SQL, op5_packing
from payflux.llm.resampling import OP11_SQL, op11_importance_resampling
from payflux.llm.sharding import OP6_SQL, op6_sharding

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_nearest_neighbours": neighbours.op7_nearest_neighbours,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_mixing": op10_mixing,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": secrets.OP1_SQL,
    "op2_embedding_dedup": embedding_dedup.OP2_SQL,
    "op3_chat_formatting": chat.OP3_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op5_packing": OP5_SQL,
    "op6_sharding": OP6_SQL,
    "op7_nearest_neighbours": neighbours.OP7_SQL,
    "op9_ngram_jaccard": jaccard.OP9_SQL,
    "op10_mixing": OP10_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_phrase_collocations": OP12_SQL,
    "op13_exact_dedup": OP13_SQL,
}
