"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from . import chat, decontaminate, embedding_dedup, jaccard_join, licences, merkle, nn_descent, packing, periodic, separators, toxicity, url_filters, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_packing": packing.op2_packing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_separators": separators.op4_separators,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_chat": chat.op6_chat,
    "op7_licences": licences.op7_licences,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_warc": warc.op9_warc,
    "op10_url_filters": url_filters.op10_url_filters,
    "op11_nearest": nn_descent.op11_nearest,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE_SQL,
    "op5_jaccard_join": jaccard_join.ORACLE_SQL,
    "op6_chat": chat.ORACLE_SQL,
    "op8_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op9_warc": warc.ORACLE_SQL,
    "op10_url_filters": url_filters.ORACLE_SQL,
    "op13_merkle": merkle.ORACLE_SQL,
}
