"""Query op3: token counts of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .tokens import byte_level_vocabulary, token_counts


def op3_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    pieces = byte_level_vocabulary(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    counts = token_counts(spark, *pieces)
    return table(spark, sf_dir, "documents").select("doc_id", counts("text").alias("n")).select("doc_id", "n.*")


SQL: dict[str, str] = {}
QUERIES = {"op3_token_counts": op3_token_counts}
