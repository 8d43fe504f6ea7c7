"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from engram.llm import decontaminate, fingerprint, jaccard, licenses, lm, mixing, quality, repair, substring, toxicity, trie, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_fingerprints": fingerprint.op2_fingerprints,
    "op3_warc_index": warc.op3_warc_index,
    "op4_quality": quality.op4_quality,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_language_model": lm.op6_language_model,
    "op7_substring_dedup": substring.op7_substring_dedup,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_conversation_repair": repair.op11_conversation_repair,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_embedding_dedup": vectors.op13_embedding_dedup,
}
ORACLES: dict[str, str] = {"op1_decontamination": decontaminate.OP1_SQL, "op3_warc_index": warc.OP3_SQL, "op5_license_scan": licenses.OP5_SQL, "op10_jaccard_join": jaccard.OP10_SQL, "op11_conversation_repair": repair.OP11_SQL, "op12_prefix_trie": trie.OP12_SQL, "op13_embedding_dedup": vectors.OP13_SQL}
