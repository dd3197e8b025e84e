"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, language_id, license_scan, ngram_jaccard, pack, prefix_trie, secrets, spelling, substring_dedup, token_counts, url_filter, warc
from .common import small_session


def _in_small_batches(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query in a session of its own, so that what runs after it finds the caller's settings."""

    @functools.wraps(query)
    def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(small_session(spark), sf_dir)

    return asked


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {
        "op1_language_id": language_id.op1_language_id,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_ngram_jaccard": ngram_jaccard.op4_ngram_jaccard,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_url_filter": url_filter.op8_url_filter,
        "op10_substring_dedup": substring_dedup.op10_substring_dedup,
        "op11_warc": warc.op11_warc,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_spelling": spelling.op13_spelling,
    }
    return {name: _in_small_batches(f) for name, f in found.items()} | {"op9_pack": pack.op9_pack, "pipeline": corpus_pipeline.run}  # op9 cuts its own slices, and larger ones cost less


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scan": secrets.OP2_SQL,
        "op4_ngram_jaccard": ngram_jaccard.OP4_SQL,
        "op5_decontaminate": decontaminate.OP5_SQL,
        "op6_embedding_dedup": embedding_dedup.OP6_SQL,
        "op8_url_filter": url_filter.OP8_SQL,
        "op11_warc": warc.OP11_SQL,
        "op12_prefix_trie": prefix_trie.OP12_SQL,
        "op13_spelling": spelling.OP13_SQL,
    }
