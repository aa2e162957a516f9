"""Incremental ingest: manifest diff, preparation, reuse of vectors, commit as a new snapshot."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.hashing import cut_bytes, truncate_utf8, xxh64_hex
from .batches import sync_batches, sync_requests  # noqa: F401  part of the ingest
from .chunking import chunk_files


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic vectors: counts of lower-case words in slots by hash, scaled to length 1."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        import re

        import xxhash

        out = []
        for text in texts:
            v = np.zeros(self.dim, np.float32)
            for word in re.split(r"[\W_]+", text):
                if len(word.encode()) >= 2:
                    v[xxhash.xxh64_intdigest(word.lower()) % self.dim] += 1
            n = np.sqrt((v * v).sum())
            out.append((v / n if n else v).tolist())
        return out


def embed_with(embedder: Embedder, tries: int = 3):
    """text column -> vector column; a batch that fails is tried again, and the reply is checked."""

    @F.arrow_udf("array<float>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = batch.to_pylist()
            for left in range(tries - 1, -1, -1):
                try:
                    vectors = embedder.embed(texts)
                    if len(vectors) != len(texts) or any(len(v) != embedder.dim for v in vectors):
                        raise ValueError("the embedder's reply has another count or dimension")
                    break
                except Exception:
                    if not left:
                        raise
            yield pa.array(vectors, pa.list_(pa.float32()))

    return embed


def embed_input(repo: Column, relpath: Column, symbol: Column, content: Column) -> Column:
    """`repo > path[ > symbol]`, a newline and the content, cut to EMBED_BYTES."""
    return truncate_utf8(K.EMBED_BYTES)(F.concat(F.concat_ws(" > ", repo, relpath, symbol), F.lit("\n"), content))


def embed_text(repo: str | None, relpath: str | None, symbol: str | None, content: str) -> str:
    """`embed_input` of one chunk."""
    return cut_bytes(" > ".join(x for x in (repo, relpath, symbol) if x is not None) + "\n" + content, K.EMBED_BYTES)


def manifest_diff(disk: DataFrame, stored: DataFrame, full: bool = False) -> DataFrame:
    """relpath, action (delete, unchanged, upsert) of two manifests (relpath, hash)."""
    d, s = disk.select("relpath", F.col("hash").alias("now")), stored.select("relpath", F.col("hash").alias("was"))
    same = (F.col("now") == F.col("was")) & F.lit(not full)
    return d.join(s, "relpath", "full_outer").select("relpath", F.when(F.col("now").isNull(), "delete").when(same, "unchanged").otherwise("upsert").alias("action"))


def prepare(files: DataFrame) -> DataFrame:
    """Chunks of files with `input` and `content_hash` (of the input, header included)."""
    chunks = chunk_files(files)
    told = chunks.withColumn("input", embed_input(F.col("repo_key"), F.col("relpath"), F.col("symbol"), F.col("content")))
    return told.withColumn("content_hash", xxh64_hex(F.col("input")))


def with_vectors(prepared: DataFrame, known: DataFrame, embedder: Embedder) -> DataFrame:
    """The prepared chunks with `embedding` and `reused`; an input whose hash is known anywhere is not
    embedded again, and each new input is embedded once."""
    have = known.select("content_hash", "embedding").groupBy("content_hash").agg(F.first("embedding").alias("embedding"))
    missing = prepared.select("content_hash", "input").dropDuplicates(["content_hash"]).join(have, "content_hash", "left_anti")
    fresh = missing.select("content_hash", embed_with(embedder)(F.col("input")).alias("embedding"), F.lit(False).alias("reused"))
    needed = prepared.select("content_hash").distinct()
    old = have.join(needed, "content_hash", "left_semi").withColumn("reused", F.lit(True))
    return prepared.join(fresh.unionByName(old), "content_hash")


@dataclass
class Snapshot:
    """files: repo_key, relpath, hash, size, mtime_ms; chunks: chunk_id, repo_key, relpath, seq, lines, symbol,
    content, content_hash, embedding, mtime_ms."""

    files: DataFrame
    chunks: DataFrame


def sync(state: Snapshot, uploads: DataFrame, deletes: DataFrame, embedder: Embedder) -> tuple[Snapshot, DataFrame]:
    """The state after uploads (repo_key, relpath, content, mtime_ms) and deletes (repo_key, relpath), and the
    outcome's counts.  Ids go on from the largest one, in path order."""
    keys = ["repo_key", "relpath"]
    made = with_vectors(prepare(uploads), state.chunks, embedder)
    # Chunks and their vectors are kept before they are used three times, so that a model is asked once.
    made = made.withColumns({"mtime_ms": F.lit(None).cast("long")}).drop("mtime_ms").join(uploads.select(*keys, "mtime_ms"), keys).persist()
    gone = uploads.select(*keys).unionByName(deletes.select(*keys)).distinct()
    last = state.chunks.agg(F.coalesce(F.max("chunk_id"), F.lit(0)).alias("last"))
    number = F.row_number().over(Window.partitionBy("repo_key").orderBy("relpath", "seq"))
    sizes = made.groupBy("repo_key").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("repo_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    fresh = made.withColumn("k", number).join(F.broadcast(sizes), "repo_key").crossJoin(F.broadcast(last)).withColumn("chunk_id", F.col("last") + F.col("before") + F.col("k"))
    columns = state.chunks.columns
    chunks = state.chunks.join(gone, keys, "left_anti").unionByName(fresh.select(*columns))
    rows = uploads.select(*keys, xxh64_hex(F.col("content")).alias("hash"), F.octet_length("content").cast("long").alias("size"), "mtime_ms")
    files = state.files.join(gone, keys, "left_anti").unionByName(rows.select(*state.files.columns))
    per_file = made.groupBy(*keys).agg(F.count_distinct(F.when(~F.col("reused"), F.col("content_hash"))).alias("embedded"), F.count_distinct(F.when(F.col("reused"), F.col("content_hash"))).alias("reused"))
    outcome = per_file.agg(F.coalesce(F.sum("embedded"), F.lit(0)).alias("embedded"), F.coalesce(F.sum("reused"), F.lit(0)).alias("reused")).crossJoin(uploads.agg(F.count("*").alias("indexed"))).crossJoin(deletes.agg(F.count("*").alias("deleted")))
    return Snapshot(files, chunks), outcome


def empty_snapshot(spark) -> Snapshot:
    return Snapshot(
        spark.createDataFrame([], "repo_key string, relpath string, hash string, size long, mtime_ms long"),
        spark.createDataFrame([], "chunk_id long, repo_key string, relpath string, seq int, start_line int, end_line int, symbol string, content string, content_hash string, embedding array<float>, mtime_ms long"),
    )


def stale_anchors(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """Anchors whose file is stored under another hash now (a file that is gone makes none stale)."""
    same = files.select("repo_id", "relpath", F.col("hash").alias("now"))
    return anchors.join(same, ["repo_id", "relpath"]).where("hash <> now").drop("now")


def plan_index(disk: DataFrame, state: Snapshot, full: bool = False, max_files: int = 10_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(uploads, deletes, counts) that bring the stored files of each repository up to those on disk (repo_key,
    relpath, content, mtime_ms).  A repository with more than `max_files` files is refused."""
    now = disk.withColumn("hash", xxh64_hex(F.col("content")))
    crowded = now.groupBy("repo_key").agg(F.count("*").alias("n")).where(F.col("n") > max_files).first()
    if crowded:
        raise ValueError(f"{crowded.repo_key} has {crowded.n} files; at most {max_files} are indexed")
    keys = ["repo_key", "relpath"]
    repos = now.select("repo_key").distinct()
    was = state.files.join(F.broadcast(repos), "repo_key", "left_semi").select(*keys, F.col("hash").alias("was"))  # one key a repository
    both = now.join(was, keys, "full_outer")
    action = F.when(F.col("hash").isNull(), "delete").when((F.col("hash") == F.col("was")) & F.lit(not full), "unchanged").otherwise("upsert")
    told = both.withColumn("action", action)
    counts = told.agg(F.count_if(F.col("action") == "upsert").alias("indexed"), F.count_if(F.col("action") == "unchanged").alias("unchanged"), F.count_if(F.col("action") == "delete").alias("deleted"))
    return told.where("action = 'upsert'").select(*keys, "content", "mtime_ms"), told.where("action = 'delete'").select(*keys), counts


def prune(state: Snapshot, repo_key: str) -> Snapshot:
    """The state without a repository's files and chunks."""
    return Snapshot(state.files.where(F.col("repo_key") != repo_key), state.chunks.where(F.col("repo_key") != repo_key))


def query_vectors(queries: DataFrame, memo: DataFrame, embedder: Embedder) -> tuple[DataFrame, DataFrame]:
    """(queries with `embedding`, the grown memo (query, embedding)): each distinct new text is embedded once."""
    new = queries.select("query").distinct().join(memo, "query", "left_anti").withColumn("embedding", embed_with(embedder)(F.col("query")))
    grown = memo.select("query", "embedding").unionByName(new)
    return queries.join(grown, "query"), grown


def write_snapshot(state: Snapshot, folder: str, version: int) -> None:
    """A new version of all tables; readers see it once its mark is written last."""
    state.files.write.mode("overwrite").parquet(f"{folder}/v={version}/files")
    state.chunks.write.mode("overwrite").partitionBy("repo_key").parquet(f"{folder}/v={version}/chunks")
    state.files.sparkSession.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{folder}/v={version}/committed")


def read_snapshot(spark, folder: str, version: int) -> Snapshot:
    spark.read.parquet(f"{folder}/v={version}/committed").first()  # fails if the version was not completed
    none = empty_snapshot(spark)
    return Snapshot(spark.read.schema(none.files.schema).parquet(f"{folder}/v={version}/files"), spark.read.schema(none.chunks.schema).parquet(f"{folder}/v={version}/chunks").select(*none.chunks.columns))
