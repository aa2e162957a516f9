"""A corpus pipeline: language ID, near duplicates, benchmark decontamination, secrets, packing.

Each stage gets the documents that its predecessor kept and returns what it keeps, with the columns of
documents; the last one returns the packed pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillstone.llm.common import shared_folder
from quillstone.llm.decontaminate import decontaminate
from quillstone.llm.langid import keep_known
from quillstone.llm.ngram_join import one_of_each
from quillstone.llm.packing import pack
from quillstone.llm.secrets import mask_secrets


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an unknown language go; `lang` becomes the language found."""
    return keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more, and what such links reach) the
    document with the smallest id stays.  Documents without an id or without words stay; rows that repeat an id all
    go or stay."""
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("packing", packing)]

ORACLE_SQL = None  # models and tokenisers are beyond SQL; tests compare with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
