"""Query op6: secrets in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .secrets import scan_secrets


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    secret = F.filter("scan.findings", lambda f: f["secret"])
    return scanned.select(
        "doc_id",
        F.size("scan.findings").cast("long").alias("n_candidates"),
        F.size(secret).cast("long").alias("n_secrets"),
        F.array_join(F.transform(secret, lambda f: F.concat_ws(":", f["line"], f["column"], F.length(f["value"]))), ",").alias("spans"),
        F.sha2("scan.masked", 256).alias("masked_sha256"),
    )


SQL: dict[str, str] = {}
QUERIES = {"op6_secret_scan": op6_secret_scan}
