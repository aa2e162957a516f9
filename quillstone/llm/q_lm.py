"""Query op13: all documents scored by a language model of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .lm import score_texts


def op13_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return score_texts(table(spark, sf_dir, "documents"), held_out)


SQL: dict[str, str] = {}
QUERIES = {"op13_lm_score": op13_lm_score}
