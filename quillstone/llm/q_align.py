"""Query op11: two tokenizers aligned over all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .align import align
from .common import table


def op11_token_align(spark: SparkSession, sf_dir: str, tokenizer: str | None = None, piece_model: str | None = None) -> DataFrame:
    paths = tokenizer or public_tokenizers.path("byte_bpe_50k.json"), piece_model or public_tokenizers.path("piece_bpe_32k.model")
    return align(table(spark, sf_dir, "documents"), *paths)


SQL: dict[str, str] = {}
QUERIES = {"op11_token_align": op11_token_align}
