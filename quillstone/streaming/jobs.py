"""Streams: sync of uploads, debounced bursts of changes, votes on notes.

The event-time window and watermark of `bursts` are this engine's own additions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPLOAD = "repo_key string, relpath string, content string, mtime_ms long, deleted boolean"


def uploads(spark: SparkSession, folder: str, schema: str = UPLOAD) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


def latest(batch: DataFrame) -> DataFrame:
    """The last version of each file in a batch."""
    order = F.struct("mtime_ms", F.xxhash64("content"))
    return batch.groupBy("repo_key", "relpath").agg(F.max_by(F.struct("content", "mtime_ms", "deleted"), order).alias("v")).select("repo_key", "relpath", "v.*")


def sync_stream(stream: DataFrame, apply: Callable[[DataFrame, DataFrame], None], checkpoint: str, trigger: dict | None = None):
    """Each micro-batch of uploads goes to `apply(upserts, deletes)`, which must not mind seeing one again.

    An error of one batch is raised to the query, which restarts from its checkpoint."""

    def run(batch: DataFrame, _: int) -> None:
        last = latest(batch).persist()
        apply(last.where(~F.coalesce("deleted", F.lit(False))).drop("deleted"), last.where("deleted").select("repo_key", "relpath"))
        last.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()


def then_stale(commit: Callable[[DataFrame, DataFrame], None], mark: Callable[[DataFrame], None]) -> Callable[[DataFrame, DataFrame], None]:
    """An `apply` for `sync_stream` that stores a batch first, and then gives `mark` the stored files (repo_key, relpath,
    hash), whose anchors may be stale now.  Deleted files are not among them."""
    from ..functions.hashing import xxh64_hex

    def apply(upserts: DataFrame, deletes: DataFrame) -> None:
        commit(upserts, deletes)
        mark(upserts.select("repo_key", "relpath", xxh64_hex(F.col("content")).alias("hash")))

    return apply


def store_stream(stream: DataFrame, store, embedder, clock: Callable[[], int], checkpoint: str, trigger: dict | None = None):
    """Each micro-batch of uploads is one commit of a `Store`, staleness included; one that comes again changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        last = latest(batch)
        keep = ~F.coalesce("deleted", F.lit(False))
        store.commit(last.where(keep).drop("deleted"), last.where("deleted").select("repo_key", "relpath"), embedder, clock(), number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "500 milliseconds"})).start()


OFFSET_OUT = "session string, offset long"


def offset_state(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """How far a session has been read; lines that come again or late never take it back."""
    offset = state.get[0] if state.exists else 0
    for pdf in batches:
        offset = max(offset, int(pdf["line_no"].max()))
    state.update((offset,))
    yield pd.DataFrame({"session": [key[0]], "offset": [offset]})


def offsets(stream: DataFrame) -> DataFrame:
    """session and its offset after each micro-batch of lines (session, line_no)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return stream.groupBy("session").applyInPandasWithState(offset_state, OFFSET_OUT, "offset long", "update", GroupStateTimeout.NoTimeout)


def bursts(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 minutes", key: str = "user_id", ts: str = "ts") -> DataFrame:
    """A row per burst of a key's events: those closer than `gap` are one."""
    stamped = events.withWatermark(ts, late) if events.isStreaming else events
    return stamped.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


VOTE_OUT = "note_id long, helpful long, noise long, last_helpful long"


def vote_state(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Running counts of a note's votes (note_id, seq, ts, helpful); a vote at or before the last seen
    sequence number is a repeat and counts once."""
    helpful, noise, last, seen = state.get if state.exists else (0, 0, 0, -1)
    for pdf in batches:
        for row in pdf.sort_values("seq").itertuples():
            if row.seq <= seen:
                continue
            seen = int(row.seq)
            if row.helpful:
                helpful, last = helpful + 1, int(row.ts)
            else:
                noise += 1
    state.update((helpful, noise, last, seen))
    yield pd.DataFrame({"note_id": [key[0]], "helpful": [helpful], "noise": [noise], "last_helpful": [last]})


def votes(stream: DataFrame) -> DataFrame:
    """note_id and its counts after each micro-batch."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return stream.groupBy("note_id").applyInPandasWithState(vote_state, VOTE_OUT, "helpful long, noise long, last long, seen long", "update", GroupStateTimeout.NoTimeout)


def gc_due(stamp: str, now: float, every: float = 86_400) -> bool:
    """Whether a day has passed since the stamp file was written; writes it if so."""
    path = Path(stamp)
    if path.exists() and now - float(path.read_text() or 0) < every:
        return False
    path.write_text(str(now))
    return True
