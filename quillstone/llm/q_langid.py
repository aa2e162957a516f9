"""Query op10: the language of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .langid import identify


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op10_language_id": op10_language_id}
