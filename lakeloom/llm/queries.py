"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, embedding_lsh, language_id, lexical_search, license_scan, line_dedup, resampling, sentencepiece_codec, simhash, token_counts, token_output, toxicity, warc_fixity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_language_id": language_id.op2_language_id,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_warc_fixity": warc_fixity.op5_warc_fixity,
        "op6_simhash": simhash.op6_simhash,
        "op7_embedding_lsh": embedding_lsh.op7_embedding_lsh,
        "op8_token_counts": token_counts.op8_token_counts,
        "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_resampling": resampling.op11_resampling,
        "op12_token_ids": token_output.op12_token_ids,
        "op13_lexical_search": lexical_search.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_warc_fixity": warc_fixity.OP5_SQL, "op11_resampling": resampling.OP11_SQL, "op13_lexical_search": lexical_search.OP13_SQL}
