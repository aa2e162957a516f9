"""The note stream in any split against the fold of the table, and both against one event after another; exact ranks."""

import random
import statistics

from pyspark.sql import functions as F

from quillstone.operators import evaluation
from quillstone.streaming import note_state as S

SCHEMA = "note_id long, seq long, sec long, kind string"
KINDS = ["helpful", "noise", "touch", "stale", "archive", "restore", "other"]


def one_by_one(rows):
    out = {}
    for note, seq, sec, kind in sorted(set(rows), key=lambda r: (r[2], r[1])):
        s = out.setdefault(note, {"access": 0, "helpful": 0, "noise": 0, "helpful_at": None, "status": "live", "stale_at": None})
        S.act(s, sec * 1000, kind)
    return {n: (s["access"], s["helpful"], s["noise"], s["helpful_at"], s["status"], s["stale_at"]) for n, s in out.items()}


def told(rows):
    return {r.note_id: (r.access_count, r.helpful_count, r.noise_count, r.helpful_at, r.status, r.stale_at) for r in rows}


def test_stream_and_fold_are_the_events_one_by_one(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.randrange(6), i, 1_000 + 20 * (i // 3), rng.choice(KINDS)) for i in range(240)]
    events = lambda df: df.withColumn("at", F.timestamp_seconds("sec"))
    assert told(S.fold(events(spark.createDataFrame(rows + rows[:50], SCHEMA))).collect()) == one_by_one(rows)
    # Three batches, shuffled within the lateness, each with events of the one before again.
    shuffled = sorted(rows, key=lambda r: r[2] + rng.randrange(300))
    cuts = [shuffled[:80], shuffled[70:160], shuffled[150:]]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    try:
        seen = {}
        for i, cut in enumerate(cuts):
            spark.createDataFrame(cut, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            stream = S.note_states(events(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))), "10 minutes")
            run = stream.writeStream.foreachBatch(lambda df, _: seen.update(told(df.collect()))).outputMode("update").trigger(availableNow=True)
            run.option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination(200)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert seen == one_by_one(rows)


def test_exact_ranks_of_groups_of_any_size(spark):
    rng = random.Random(9)
    rows = [("a" if rng.random() < 0.8 else rng.choice(["b", None]), rng.choice([1.5, 2.0, rng.random(), None])) for _ in range(900)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    for p in (0, 50, 95, 100):
        want = {}
        for k in ("a", "b", None):
            own = sorted(v for g, v in rows if g == k and v is not None)
            want[k] = own[(len(own) - 1) * p // 100]
        assert {r.k: r[1] for r in evaluation.percentile(df, "v", p, ["k"]).collect()} == want
    for part in (rows, rows[:7], rows[:8]):
        own = spark.createDataFrame(part, "k string, v double")
        assert abs(evaluation.median(own, "v").first().median - statistics.median([v for _, v in part if v is not None])) < 1e-12
    assert evaluation.median(df.limit(0), "v").first().median is None
    assert evaluation.percentile(df.limit(0), "v", 50, ["k"]).count() == 0
