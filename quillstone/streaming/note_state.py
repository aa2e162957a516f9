"""The state of each note as a stream of what happens to it, and the same as a fold over a table.

Events: note_id, seq, at (timestamp), kind: helpful, noise, touch, stale, archive, restore; others change nothing.  They act
in the order of at and seq.  Votes and touches count; `stale` dates a note that is not archived, `archive` keeps the date, and
`restore` makes an archived note live without one.  An event that comes again counts once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import constants as K

STATE = "note_id long, access_count long, helpful_count long, noise_count long, salience_factor double, helpful_at long, status string, stale_at long"
SETTLED = "access long, helpful long, noise long, helpful_at long, status string, stale_at long, upto_ms long"
WAITING = "ms array<long>, seq array<long>, kind array<string>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def act(s: dict, ms: int, kind: str) -> None:
    if kind == "touch":
        s["access"] += 1
    elif kind == "helpful":
        s["helpful"] += 1
        s["helpful_at"] = ms // 1000
    elif kind == "noise":
        s["noise"] += 1
    elif kind == "archive":
        s["status"] = "archived"
    elif kind == "stale" and s["status"] != "archived":
        s["status"], s["stale_at"] = "stale", ms // 1000
    elif kind == "restore" and s["status"] == "archived":
        s["status"], s["stale_at"] = "live", None


class NoteState(StatefulProcessor):
    """Events wait, by time and number, until the watermark has passed them; only then are they part of the settled state.
    So events may come in any order and split within the lateness, and what is kept of a note stays small."""

    NAMES = tuple(f.split()[0] for f in SETTLED.split(", "))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", SETTLED)
        self.waiting = handle.getValueState("waiting", WAITING)

    def _settled(self) -> dict:
        return dict(zip(self.NAMES, self.settled.get() if self.settled.exists() else (0, 0, 0, None, "live", None, -(1 << 62))))

    def _waiting(self) -> dict:
        """The kinds of the events that wait, by time and number: one value, so that a call reads or writes all of them."""
        return {(ms, seq): kind for ms, seq, kind in zip(*self.waiting.get())} if self.waiting.exists() else {}

    def _wait(self, waiting: dict) -> None:
        if waiting:
            self.waiting.update(([ms for ms, _ in waiting], [seq for _, seq in waiting], list(waiting.values())))
        else:
            self.waiting.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        s, waiting, last = self._settled(), self._waiting(), None
        for pdf in rows:
            for ms, seq, kind in zip(pdf["ms"].tolist(), pdf["seq"].tolist(), pdf["kind"].tolist()):
                if ms > s["upto_ms"]:  # what is settled has come before
                    waiting[ms, seq] = kind
                    last = ms if last is None else max(last, ms)
        if last is not None:
            self.handle.registerTimer(last + 1)
            self._wait(waiting)
        for ms, seq in sorted(waiting):
            act(s, ms, waiting[ms, seq])
        yield pd.DataFrame({
            "note_id": [key[0]], "access_count": [s["access"]], "helpful_count": [s["helpful"]], "noise_count": [s["noise"]], "salience_factor": [K.NOISE_DECAY ** s["noise"]],
            "helpful_at": pd.array([s["helpful_at"]], "Int64"), "status": [s["status"]], "stale_at": pd.array([s["stale_at"]], "Int64"),
        })

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        s, waiting, passed = self._settled(), self._waiting(), timerValues.getCurrentWatermarkInMs()
        due = sorted(e for e in waiting if e[0] < passed)
        if not due:
            return iter(())
        for ms, seq in due:
            act(s, ms, waiting.pop((ms, seq)))
        s["upto_ms"] = max(s["upto_ms"], due[-1][0])
        self._wait(waiting)
        self.settled.update(tuple(s[n] for n in self.NAMES))
        return iter(())

    def close(self) -> None:
        pass


def note_states(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The state of each note that a micro-batch tells of, after it.  Events later than `late` are dropped.

    The session must use the RocksDB state store (`ROCKSDB` as spark.sql.streaming.stateStore.providerClass)."""
    own = events.select("note_id", "seq", "at", F.unix_millis(F.col("at")).alias("ms"), "kind").withWatermark("at", late)
    return own.groupBy("note_id").transformWithStateInPandas(NoteState(), STATE, "Update", "EventTime")


def fold(events: DataFrame) -> DataFrame:
    """The same over a table, in window functions."""
    own = events.where("note_id is not null and at is not null").dropDuplicates(["note_id", "at", "seq"]).withColumn("sec", F.floor(F.unix_millis(F.col("at")) / 1000))
    order = Window.partitionBy("note_id").orderBy("at", "seq")
    turn = F.when(F.col("kind").isin("archive", "restore"), F.col("kind") == "archive")
    away = F.coalesce(F.last(turn, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    dated = F.when((F.col("kind") == "stale") & ~away, F.struct("at", "seq", "sec")).when((F.col("kind") == "restore") & away, F.struct("at", "seq", F.lit(None).cast("long").alias("sec")))
    rows = own.withColumns({"dated": dated, "turned": F.when(turn.isNotNull(), F.struct("at", "seq", turn.alias("away")))})
    n = lambda kind: F.count_if(F.col("kind") == kind)
    out = rows.groupBy("note_id").agg(n("touch").alias("access_count"), n("helpful").alias("helpful_count"), n("noise").alias("noise_count"), F.max(F.when(F.col("kind") == "helpful", F.col("sec"))).alias("helpful_at"), F.max("turned").alias("t"), F.max("dated").alias("d"))
    status = F.when(F.col("t.away"), "archived").when(F.col("d.sec").isNotNull(), "stale").otherwise("live")
    return out.select("note_id", "access_count", "helpful_count", "noise_count", F.pow(F.lit(K.NOISE_DECAY), "noise_count").alias("salience_factor"), "helpful_at", status.alias("status"), F.col("d.sec").alias("stale_at"))
