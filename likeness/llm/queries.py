"""The queries of this subpackage, and plain SQL that checks those that SQL can express.

``op1``, ``op3``, ``op5`` to ``op10``, ``op12`` and ``op13`` have no SQL: their methods' own values or checksums lie beyond
it, or it would take all pairs. They are tested against brute force.
"""

from __future__ import annotations

from likeness.llm import (
    conversations,
    decontamination,
    jaccard,
    kneser_ney,
    licenses,
    mixing,
    packing,
    quality_rules,
    recompression,
    sharding,
    suffix_dedup,
    urls,
    whitening,
)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_url_filter": urls.op2_url_filter,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_quality_classifier": kneser_ney.op6_quality_classifier,
    "op7_benchmark_decontamination": decontamination.op7_benchmark_decontamination,
    "op8_packing": packing.op8_packing,
    "op9_sharding": sharding.op9_sharding,
    "op10_substring_dedup": recompression.op10_substring_dedup,
    "op11_source_mixing": mixing.op11_source_mixing,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

SQL = {"op2_url_filter": urls.SQL, "op4_license_scan": licenses.SQL, "op11_source_mixing": mixing.SQL}
