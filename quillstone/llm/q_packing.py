"""Query op5: all documents packed into sequences of 1024 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack


def op5_best_fit_pack(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


SQL: dict[str, str] = {}
QUERIES = {"op5_best_fit_pack": op5_best_fit_pack}
