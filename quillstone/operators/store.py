"""The index kept in a folder: a commit writes the buckets it touches, and its mark last.

Tables without texts are dealt into buckets by a hash of their key.  A commit reads and writes only the buckets that its rows
fall into, under a new version; a bucket nobody touched stays where it is.  The commit's own table, one small file that appears
at once, says for each bucket of each table under which version it lies; before it is there, readers see the state before.
A commit that was broken off leaves data that nothing names, and is written over when it is tried again.  The number
of the last micro-batch is part of the commit, so a batch that comes again changes nothing.  There is one writer at a time.

Tables: files (repo_key, relpath), lengths (same key), vectors (content_hash), anchors (repo_key, relpath) and notes (id).
Chunks and the lexical index (see lexicon) have a segment for each commit, until `merge` puts them together: texts are dealt out
once, in path order, and written once, and a commit rewrites none.  A chunk without a length is gone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keeping import keep, stored
from . import lexicon as L
from . import notes as N
from .chunking import cutter
from .ingest import Embedder, embed_input, embed_text, embed_with

SCHEMAS = {
    "files": "repo_key string, relpath string, hash string, size long, mtime_ms long",
    "chunks": "chunk_id long, repo_key string, relpath string, seq int, start_line int, end_line int, symbol string, content string, content_hash string, mtime_ms long",
    "vectors": "content_hash string, embedding array<float>",
    "lengths": "chunk_id long, repo_key string, relpath string, len long",
    "anchors": "repo_key string, relpath string, hash string, note_id long",
    "notes": "id long, repo_id long, kind string, content string, salience double, status string, superseded_by long, created_at long, last_access long, access_count long, helpful_count long, noise_count long, source string, stale_at long, helpful_at long, reverified_at long, contradicted_at long",
}
# A segment of texts: a row without seq for each file, then its chunks; ids begin at `start` in each task that wrote it.
_TEXTS = "repo_key string, relpath string, mtime_ms long, hash string, size long, task int, seq int, start_line int, end_line int, symbol string, content string, number long, content_hash string"
_STARTS = "task int, start long"
_CODEC = "zstd"
_FEW = 250_000  # ids that are broadcast
KEYS = {"files": ["repo_key", "relpath"], "lengths": ["repo_key", "relpath"], "chunks": ["repo_key", "relpath"], "anchors": ["repo_key", "relpath"], "vectors": ["content_hash"], "notes": ["id"]}
_COMMIT = "version long, batch long, last_chunk long, table string, bucket int, at long"


def _input() -> Column:
    return embed_input(F.col("repo_key"), F.col("relpath"), F.col("symbol"), F.col("content"))


def _laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files -> rows of a segment of texts; files without a key have no chunks.  One Python process does it all."""
    import xxhash

    def hashed() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("content").cast(pa.binary())
            named = pc.and_(pc.is_valid(batch.column("repo_key")), pc.is_valid(batch.column("relpath")))
            own = {c: batch.column(c) for c in ("repo_key", "relpath", "mtime_ms", "task")}
            own["hash"] = pa.array([xxhash.xxh64_hexdigest(x.as_buffer()) if x.is_valid else None for x in raw], pa.string())
            own["size"] = pc.binary_length(raw).cast(pa.int64())
            own["content"] = pc.if_else(named, batch.column("content"), None)
            yield pa.RecordBatch.from_pydict(own)

    for batch in cutter(["repo_key", "relpath", "mtime_ms", "hash", "size", "task"], numbered=True)(hashed()):
        parts = zip(*[batch.column(c) for c in ("repo_key", "relpath", "symbol", "content")])
        told = [xxhash.xxh64_hexdigest(embed_text(*[x.as_py() for x in p]).encode()) if p[3].is_valid else None for p in parts]
        yield batch.append_column("content_hash", pa.array(told, pa.string())).select([c.split()[0] for c in _TEXTS.split(", ")])


def _cut(uploads: DataFrame) -> DataFrame:
    keys = KEYS["files"]
    dealt = uploads.select(*keys, "content", F.col("mtime_ms").cast("long").alias("mtime_ms")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return dealt.withColumn("task", F.spark_partition_id()).mapInArrow(_laid, _TEXTS)


def _only(chunks: DataFrame, ids: DataFrame, total: int) -> DataFrame:
    """Those of `total` chunks whose chunk_id is among `ids`; the texts stay where they are unless ids and rest are both many."""
    n = ids.count()
    if n == total:
        return chunks
    if total - n < n:
        rest = stored(chunks.select("chunk_id").join(ids, "chunk_id", "left_anti"))
        return chunks.join(F.broadcast(rest) if total - n <= _FEW else rest, "chunk_id", "left_anti")
    return chunks.join(F.broadcast(ids) if n <= _FEW else ids, "chunk_id", "left_semi")


@dataclass
class Commit:
    """A version, the last micro-batch in it, the largest chunk id so far, and where each bucket lies."""

    version: int = 0
    batch: int = -1
    last_chunk: int = 0
    at: dict[tuple[str, int], int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*KEYS[table]), F.lit(self.buckets)).cast("int")

    def latest(self, version: int | None = None) -> Commit:
        """The last commit, or the one with that number."""
        try:
            rows = self.spark.read.schema(_COMMIT).parquet(f"{self.folder}/commits")
        except AnalysisException:  # there is none yet
            return Commit()
        if version is None:
            version = rows.agg(F.max("version")).first()[0]
        own = rows.where(F.col("version") == F.lit(version)).collect()  # a row for each bucket of each table
        if not own:
            if version:
                raise ValueError(f"version {version} was not committed")
            return Commit()
        return Commit(version, own[0].batch, own[0].last_chunk, {(r.table, r.bucket): r.at for r in own if r.table})

    def table(self, name: str, commit: Commit | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as of a commit, or those buckets of it."""
        commit = commit or self.latest()
        paths = [f"{self.folder}/data/{name}/v={v}/bucket={b}" for (t, b), v in sorted(commit.at.items()) if t == name and (buckets is None or b in buckets)]
        rows = self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])
        if name != "chunks":
            return rows
        segments = [v for (t, _), v in sorted(commit.at.items()) if t == "texts"]
        if segments:  # folders from before there were segments have buckets
            rows = rows.unionByName(self._texts(segments)) if paths else self._texts(segments)
        return rows.join(self.table("lengths", commit).select("chunk_id"), "chunk_id", "left_semi").select(*rows.columns)

    def _texts(self, versions: list[int]) -> DataFrame:
        """The chunks of segments, those that are gone too."""
        read = lambda name, schema: self.spark.read.option("basePath", f"{self.folder}/data/{name}").schema(f"{schema}, v long").parquet(*[f"{self.folder}/data/{name}/v={v}" for v in versions])
        starts = F.broadcast(read("starts", _STARTS))  # a row for each task that wrote
        rows = read("texts", _TEXTS).where("seq is not null").join(starts, ["v", "task"]).withColumn("chunk_id", F.col("start") + F.col("number"))
        return rows.select(*[c.split()[0] for c in SCHEMAS["chunks"].split(", ")])

    def _write_segment(self, name: str, version: int, rows: DataFrame, schema: str) -> None:
        rows.select(*[c.split()[0] for c in schema.split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/data/{name}/v={version}", compression=_CODEC)

    def _touched(self, name: str, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket(name)).distinct().collect())  # at most `buckets`

    def _write(self, name: str, version: int, rows: DataFrame, touched: list[int], at: dict) -> None:
        """All rows that the touched buckets hold from now on."""
        path = f"{self.folder}/data/{name}/v={version}"
        names = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        rows.select(*names, self.bucket(name).alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        try:
            there = {r[0] for r in self.spark.read.parquet(path).select("bucket").distinct().collect()}
        except AnalysisException:  # no row is left
            there = set()
        for b in touched:
            at.pop((name, b), None)
            if b in there:
                at[name, b] = version

    def _mark(self, commit: Commit) -> Commit:
        rows = [(commit.version, commit.batch, commit.last_chunk, t, b, v) for (t, b), v in sorted(commit.at.items())]
        rows = rows or [(commit.version, commit.batch, commit.last_chunk, None, None, None)]
        self.spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return commit

    def put(self, name: str, rows: DataFrame, whole_keys: bool = True) -> Commit:
        """Rows of a table (notes, anchors) in place of those with the same key, or beside them."""
        old = self.latest()
        new = Commit(old.version + 1, old.batch, old.last_chunk, dict(old.at))
        rows = stored(rows)
        touched = self._touched(name, rows)
        there = self.table(name, old, touched)
        if whole_keys:
            there = there.join(rows.select(*KEYS[name]).distinct(), KEYS[name], "left_anti")
        self._write(name, new.version, there.unionByName(rows.select(*there.columns)), touched, new.at)
        return self._mark(new)

    def commit(self, uploads: DataFrame, deletes: DataFrame, embedder: Embedder, now: int, batch: int | None = None) -> Commit:
        """Store uploads (repo_key, relpath, content, mtime_ms; a path once) and forget deletes (repo_key, relpath).

        In the same commit, notes become stale whose anchor to an uploaded file has another hash.  Chunk ids go on from
        the largest so far, in path order.  An input whose vector is known is not embedded again."""
        old = self.latest()
        if batch is not None and batch <= old.batch:
            return old
        new = Commit(old.version + 1, old.batch if batch is None else batch, old.last_chunk, dict(old.at))
        keys = KEYS["files"]
        self._write_segment("texts", new.version, _cut(uploads), _TEXTS)
        laid = self.spark.read.schema(_TEXTS).parquet(f"{self.folder}/data/texts/v={new.version}")
        files = laid.where("seq is null").select(*keys, "hash", "size", "mtime_ms")
        gone = files.select(*keys).unionByName(deletes.select(*keys)).distinct()
        touched = self._touched("files", gone)
        without = lambda name: self.table(name, old, touched).join(gone, keys, "left_anti")
        self._write("files", new.version, without("files").unionByName(files), touched, new.at)

        counts = laid.where("seq is not null").groupBy("task").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = counts.select("task", (before + old.last_chunk + 1).alias("start"))
        self._write_segment("starts", new.version, starts.coalesce(1), _STARTS)
        new.at["texts", new.version] = new.version
        made = self._texts([new.version])
        new.last_chunk += laid.where("seq is not null").count()
        segment = f"{self.folder}/data/segments/v={new.version}"
        L.write_segment(made, segment, codec=_CODEC)
        lengths = without("lengths")
        self._write("lengths", new.version, lengths.unionByName(L.read_segment(self.spark, segment).lengths.select(*lengths.columns)), touched, new.at)
        new.at["segments", new.version] = new.version

        known = self.table("vectors", old, self._touched("vectors", made)).select("content_hash")
        missing = stored(made.groupBy("content_hash").agg(F.min("chunk_id").alias("chunk_id")).join(known, "content_hash", "left_anti"))
        fresh = self._touched("vectors", missing)
        asked = _only(made, missing.select("chunk_id"), new.last_chunk - old.last_chunk)
        embedded = asked.select("content_hash", embed_with(embedder)(_input()).alias("embedding"))
        self._write("vectors", new.version, self.table("vectors", old, fresh).unionByName(embedded), fresh, new.at)

        anchors = self.table("anchors", old, touched).withColumnRenamed("hash", "was")
        drifted = keep(anchors.join(files.select(*keys, "hash"), keys).where("hash <> was").select("note_id").distinct())
        due = self._touched("notes", drifted.withColumnRenamed("note_id", "id"))
        self._write("notes", new.version, N.mark_stale(self.table("notes", old, due), drifted, now), due, new.at)
        return self._mark(new)

    def index(self, commit: Commit | None = None) -> L.Index:
        """The lexical index as of a commit."""
        commit = commit or self.latest()
        folders = [f"{self.folder}/data/segments/v={v}" for (t, _), v in sorted(commit.at.items()) if t == "segments"]
        lengths = self.table("lengths", commit)
        return L.Index(L.read_words(self.spark, folders).join(lengths, "chunk_id"), lengths)

    def merge(self) -> Commit:
        """One segment in place of all, without the chunks that are gone and their entries."""
        old = self.latest()
        new = Commit(old.version + 1, old.batch, old.last_chunk, {k: v for k, v in old.at.items() if k[0] not in ("segments", "texts", "chunks")})
        folder, own = f"{self.folder}/data/segments/v={new.version}", self.index(old)
        own.words.write.mode("overwrite").parquet(f"{folder}/words", compression=_CODEC)
        new.at["segments", new.version] = new.version
        rows = self.table("chunks", old).withColumns({"hash": F.lit(None).cast("string"), "size": F.lit(None).cast("long"), "task": F.lit(0), "number": F.col("chunk_id")})
        self._write_segment("texts", new.version, rows, _TEXTS)
        self._write_segment("starts", new.version, self.spark.createDataFrame([(0, 0)], _STARTS).coalesce(1), _STARTS)
        new.at["texts", new.version] = new.version
        return self._mark(new)

    def searchable(self, commit: Commit | None = None) -> DataFrame:
        """Chunks with their vectors, as the searches take them."""
        commit = commit or self.latest()
        return self.table("chunks", commit).join(self.table("vectors", commit), "content_hash")
