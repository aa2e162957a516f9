"""Readers of files, transcripts, golden sets, labelled pairs and rerank dumps."""

from __future__ import annotations

import fnmatch
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.keeping import keep


def glob_pattern(glob: str) -> str:
    return fnmatch.translate(glob).replace("\\Z", "$").replace("\\z", "$")


def read_files(spark: SparkSession, root: str, max_bytes: int = 1 << 20, skip: list[str] | None = None) -> DataFrame:
    """relpath, content, size, mtime_ms of the text files below a folder: no hidden ones, none that are empty,
    too large, not UTF-8 or of a skipped glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    relpath = F.regexp_replace("path", f"^(?:[a-z]+:/*)?/*{base.lstrip('/')}/", "")
    name = F.element_at(F.split("relpath", "/"), -1)
    rows = files.where(F.col("length").between(1, max_bytes)).withColumn("relpath", relpath).where(~F.col("relpath").rlike(r"(^|/)\."))
    for glob in skip if skip is not None else K.SKIP_GLOBS:
        rows = rows.where(~name.rlike(glob_pattern(glob)))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return rows.select("relpath", text.alias("content"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms")).where("content is not null")


def ignore_rules(patterns: list[str]) -> Column:
    """Whether a relpath is ignored by lines of an ignore file; later lines win and ! takes back."""
    out = F.lit(False)
    for line in patterns:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!")
        rooted = "/" in line.rstrip("/")
        body = glob_pattern(line.strip("/")).removeprefix("(?s:").removesuffix(")$").replace(".*", "[^/]*").replace("[^/]*[^/]*", ".*")
        hit = F.col("relpath").rlike(f"^(?:{'' if rooted else '(?:.*/)?'}{body})(?:/.*)?$")
        out = F.when(hit, F.lit(not negated)).otherwise(out)
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """session, line_no (from 1), raw of JSON-lines files, one session a file; lines end with \\n, empty ones count but are
    not among the rows.

    A file is read in many tasks: a line's number is its place in its split, and the lines of the splits before it."""
    raw = spark.read.text(path, lineSep="\n")
    parts = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("raw"))
    placed = keep(parts)  # the numbers of rows hold for one reading
    splits = placed.groupBy("file", "start").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "start", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    number = (F.col("before") + F.col("row") - F.col("first") + 1).cast("int").alias("line_no")
    return placed.join(splits, ["file", "start"]).select(F.url_decode(F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("session"), number, "raw").where("raw <> ''")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """repo, case_no, query, expect, path_prefix of a TOML set of cases."""
    with Path(path).open("rb") as f:
        data = tomllib.load(f)
    rows = [(data["meta"]["repo"], i, c["query"], list(c["expect"]), c.get("path_prefix")) for i, c in enumerate(data.get("case", []))]
    return spark.createDataFrame(rows, "repo string, case_no int, query string, expect array<string>, path_prefix string")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("claim string, evidence string, label boolean").json(path)


def read_rerank_dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query string, candidates array<struct<relpath:string,start:int,end:int,symbol:string,score:double>>, rerank array<struct<index:int,score:double>>").json(path)
