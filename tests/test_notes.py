"""Notes: scores, feedback, staleness, archive and restore."""

import math

import pytest
from pyspark.sql import functions as F

from quillstone import constants as K
from quillstone.operators import notes as N
from quillstone.operators import work as W
from quillstone.sources import models

NOW, DAY = 10_000_000, 86_400
NOTE = "id long, repo_id long, kind string, content string, salience double, status string, superseded_by long, created_at long, last_access long, access_count long, helpful_count long, noise_count long, source string, stale_at long, helpful_at long, reverified_at long, contradicted_at long"
MUTE = "note_id long, repo_id long, created_at long"


def note(id, **other):
    row = dict(id=id, repo_id=None, kind="lesson", content="c", salience=0.5, status="live", superseded_by=None, created_at=0, last_access=NOW, access_count=0, helpful_count=0, noise_count=0, source="agent", stale_at=None, helpful_at=None, reverified_at=None, contradicted_at=None)
    return tuple((row | other).values())


def table(spark, rows, schema=NOTE):
    return spark.createDataFrame(rows, schema)


def test_collection_by_rule(spark):
    stale = {"status": "stale"}
    rows = [
        note(1, superseded_by=2), note(2), note(3, **stale, stale_at=1), note(4, **stale, stale_at=1, helpful_at=5), note(5, **stale, stale_at=NOW), note(6, kind="episode", last_access=1, salience=0.05),
        note(7, kind="episode", last_access=1, salience=0.05, helpful_count=1), note(8), note(9), note(10, repo_id=7), note(11, repo_id=7, helpful_count=1), note(12, repo_id=7),
    ]
    mute = table(spark, [(8, 1, 0), (8, 2, 0), (9, 1, 0), (10, 7, 0), (11, 7, 0), (12, 3, 0)], MUTE)
    notes = table(spark, rows)
    same, counts = N.gc(notes, mute, NOW, dry_run=True)
    expected = {"superseded": 1, "stale": 1, "episode": 1, "noise": 2}
    assert {r.rule: r.n for r in counts.collect()} == expected and same.where("status = 'archived'").count() == 0
    after, counts = N.gc(notes, mute, NOW)
    assert {r.id for r in after.where("status = 'archived'").collect()} == {1, 3, 6, 8, 10}
    assert N.gc(after, mute, NOW)[1].count() == 0


def test_contradicted_and_unchecked(spark):
    s = lambda i, stale_at, **o: note(i, status="stale", stale_at=stale_at, **o)
    rows = [s(1, 1000, reverified_at=NOW, contradicted_at=NOW), s(2, NOW, contradicted_at=NOW), s(3, 1000, reverified_at=NOW), s(4, 1000, reverified_at=500), s(5, 1000), s(6, 1000, contradicted_at=500), s(7, 1000, contradicted_at=2000, helpful_at=2000)]
    after, counts = N.gc(table(spark, rows), table(spark, [], MUTE), NOW)
    assert {r.rule: r.n for r in counts.collect()} == {"contradicted": 2, "stale": 3}
    assert {r.id for r in after.where("status <> 'archived'").collect()} == {3, 7}


def test_scores(spark):
    r = spark.range(1).select(
        N.query_score(F.lit(0.8), F.lit(0.5), F.lit(2), F.lit(4), F.lit(True)).alias("q"), N.recall_score(F.lit(1.0), F.lit(1.0), F.lit(29.0), F.lit(0), F.lit(0), F.lit(False)).alias("r"),
        N.salience(F.lit(1.0), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("s"), N.salience(F.lit(0.0), F.lit(50.0), F.lit(10.0)).alias("t"),
    ).first()
    assert r.q == pytest.approx(0.8 * 0.9 * 1.25 * 0.5) and r.r == pytest.approx(0.3 + 0.7 * 0.5) and r.s == pytest.approx(0.25 + 0.4 * 0.3) and r.t == pytest.approx(0.75)


def test_surprise_sees_earlier_ones(spark):
    new = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [1.0, 0.0]), (3, 3, [0.0, 1.0])], "note_id long, seq long, embedding array<float>")
    none = spark.createDataFrame([], "note_id long, embedding array<float>")
    assert {r.note_id: round(r.surprise, 6) for r in N.surprises(new, none).collect()} == {1: 1.0, 2: 0.0, 3: 1.0}
    old = spark.createDataFrame([(9, [0.0, 1.0])], "note_id long, embedding array<float>")
    assert {r.note_id: round(r.surprise, 6) for r in N.surprises(new, old).collect()}[3] == 0.0


def test_candidates_filter_after_the_cut(spark):
    vectors = spark.createDataFrame([(i, 0 if i < 5 else 7, [1.0, i / 10]) for i in range(10)], "note_id long, part long, embedding array<float>")
    notes = table(spark, [note(i, repo_id=None if i < 5 else 7, status="archived" if i == 1 else "live") for i in range(10)])
    queries = spark.createDataFrame([(1, [1.0, 0.0], "repo", 7), (2, [1.0, 0.0], "unscoped", None), (3, [1.0, 0.0], "unseen", None)], "query_id long, embedding array<float>, scope_kind string, scope_repo_id long")
    mute = table(spark, [(0, 7, 0), (2, 0, 0)], MUTE)
    got = {}
    for r in N.candidates(queries, vectors, notes, mute, k=3).collect():
        got.setdefault(r.query_id, set()).add(r.note_id)
    assert got == {1: {2}, 2: {0}, 3: {0, 2}}
    found = N.recall(queries, vectors, notes, mute, limit=1, least=0.1).collect()
    assert {(r.query_id, r.note_id) for r in found} == {(1, 2), (2, 0), (3, 0)}
    touched = N.touch(notes, N.recall(queries, vectors, notes, mute, limit=1), NOW)
    assert touched.agg(F.sum("access_count")).first()[0] == len(found)


def test_votes_and_restore(spark):
    notes = table(spark, [note(1), note(2, salience=0.4)])
    votes = spark.createDataFrame([(1, 100, 1, False, 3), (2, 200, 1, False, 4), (3, 300, 1, True, 3), (4, 400, 2, True, 0)], "seq long, ts long, note_id long, helpful boolean, repo_id long")
    after, mute = N.apply_votes(notes, table(spark, [(2, 0, 5), (2, 9, 5)], MUTE), votes)
    one, two = after.orderBy("id").collect()
    assert (one.noise_count, one.helpful_count, one.helpful_at) == (2, 1, 300) and one.salience == pytest.approx(0.5 * 0.64) and two.last_access == 400
    assert {(r.note_id, r.repo_id) for r in mute.collect()} == {(1, 4), (2, 9)}
    archived = after.withColumn("status", F.lit("archived"))
    drifted = spark.createDataFrame([(2,)], "note_id long")
    back, left = N.restore(archived, spark.createDataFrame([(1,), (2,)], "id long"), drifted, mute, NOW)
    assert {r.id: (r.status, round(r.salience, 6), r.noise_count) for r in back.collect()} == {1: ("live", 0.5, 0), 2: ("stale", 0.4, 0)} and left.count() == 0


def test_superseding_and_stale_notes(spark):
    notes = table(spark, [note(1), note(2), note(3, superseded_by=2), note(4, status="archived")])
    after, links = N.supersede(notes, spark.createDataFrame([(1, 2), (2, 3), (9, 1)], "old_id long, new_id long"))
    assert {(r.note_id, r.related_id) for r in links.collect()} == {(2, 1)} and after.where("id = 1").first().superseded_by == 2
    drifted = spark.createDataFrame([(2,), (4,)], "note_id long")
    stale = N.mark_stale(after, drifted, NOW)
    assert {r.id: r.status for r in stale.collect()} == {1: "live", 2: "stale", 3: "live", 4: "archived"}
    anchors = spark.createDataFrame([(2, 1, 1, "b", "x"), (2, 2, 1, "a", "x"), (1, 1, 1, "a", "x")], "note_id long, seq int, repo_id long, relpath string, hash string")
    assert [(r.id, r.paths) for r in N.stale_list(stale, anchors, ["a"]).collect()] == [(2, ["a", "b"])]
    assert [r.id for r in N.reverifiable(stale, anchors).collect()] == [2]
    files = spark.createDataFrame([(1, "a", "y"), (1, "b", "z")], "repo_id long, relpath string, hash string")
    live, fresh = N.reaffirm(stale, anchors, spark.createDataFrame([(2, "seen")], "note_id long, evidence string"), files)
    assert live.where("id = 2").first().status == "live" and {r.hash for r in fresh.where("note_id = 2").collect()} == {"y", "z"}
    broken, _ = N.reaffirm(stale, anchors, spark.createDataFrame([(2, "seen")], "note_id long, evidence string"), files.where("relpath = 'a'"))
    assert broken.where("id = 2").first().status == "stale"


def test_reverification_asks_twice_only_where_needed(spark):
    class Mock:
        def ask(self, question, claim, evidence):
            if claim == "boom":
                raise ValueError
            return {"holds": 0.93 if claim == "good" else 0.1, "contradiction": 0.95 if claim == "bad" else 0.3}[question]

    rows = spark.createDataFrame([(1, "good", "e"), (2, "bad", "e"), (3, "unsure", "e"), (4, "boom", "e")], "note_id long, claim string, evidence string")
    scores = models.reverify(rows, Mock()).withColumn("verdict", N.verdict(F.col("holds"), F.col("contradiction")))
    got = {r.note_id: (r.verdict, r.contradiction) for r in scores.collect()}
    assert got[1] == ("holds", None) and got[2] == ("contradicted", 0.95) and got[3] == ("inconclusive", 0.3) and got[4][0] == "inconclusive"
    notes = table(spark, [note(i, status="stale", stale_at=5) for i in (1, 2, 3)])
    after = {r.id: r for r in N.commit_verdicts(notes, scores.where("note_id < 4"), NOW).collect()}
    assert (after[1].status, after[2].contradicted_at, after[2].reverified_at, after[3].contradicted_at, after[3].reverified_at) == ("live", NOW, NOW, None, NOW)


def test_evidence_is_cut(spark):
    cited = spark.createDataFrame([(1, 1, "a.rs", 1, 9, "x" * 12_000), (1, 2, "a.rs", 11, 20, "y"), (2, 1, "b", 1, 2, "é"), (2, 2, "b", 3, 4, "z")], "note_id long, seq int, relpath string, start_line int, end_line int, content string")
    got = {r.note_id: r for r in N.render_evidence(cited).collect()}
    assert len(got[1].evidence.encode()) == K.EVIDENCE_BYTES and got[1].cited == "a.rs:1-9"
    assert got[2].evidence == "b:1-2\né\n\nb:3-4\nz" and got[2].cited == "b:1-2, b:3-4"


def test_brief_and_prune(spark):
    rows = [note(i, salience=1 - i / 20, repo_id=None if i % 2 else 7) for i in range(8)] + [note(20, status="stale", stale_at=NOW - DAY), note(21, status="stale", stale_at=NOW - 9 * DAY), note(22, repo_id=8)]
    scopes = spark.createDataFrame([(1, 7)], "scope_id long, repo_id long")
    got = [(r.part, r.note_id) for r in N.brief(scopes, table(spark, rows), table(spark, [(0, 7, 0)], MUTE), NOW).orderBy("part", "rank").collect()]
    assert got == [("live", 1), ("live", 2), ("live", 3), ("live", 4), ("live", 6), ("stale", 20)]
    mute = table(spark, [(2, 7, 0)], MUTE)
    pruned = {r.id: (r.status, r.repo_id) for r in N.prune(table(spark, rows), mute, 7, None).collect()}
    assert pruned[2] == ("archived", None) and pruned[4] == ("live", None) and pruned[22] == ("live", 8)
    assert N.prune(table(spark, rows), mute, 7, 9).where("repo_id = 9").count() == 4


def test_work_lists(spark):
    lists = spark.createDataFrame([(1, 1, "a", 50, 50), (2, 2, "a", None, 60), (3, 1, "b", None, 70)], "id long, repo_id long, name string, closed_at long, updated_at long")
    items = spark.createDataFrame([(1, 1, "t1", "done", None, 0), (2, 1, "t2", "doing", "n", 0), (3, 2, "t3", "todo", None, 0)], "id long, list_id long, task string, status string, note string, updated_at long")
    state = spark.createDataFrame([(1, "k", "mine"), (1, "own", "x"), (2, "k", "theirs")], "list_id long, key string, value string")
    new = spark.createDataFrame([(1, 1, "a", "t4", None), (2, 1, "new", "t5", "doing"), (3, 1, "a", "bad", "what")], "seq long, repo_id long, name string, task string, status string")
    lists2, items2 = W.add_items(lists, items, new, NOW)
    assert {(r.id, r.name, r.closed_at) for r in lists2.collect()} == {(1, "a", None), (2, "a", None), (3, "b", None), (4, "new", None)}
    assert {(r.id, r.list_id, r.status) for r in items2.where("id > 3").collect()} == {(4, 1, "todo"), (5, 4, "doing")}
    changed = W.update_items(items, lists, spark.createDataFrame([(1, 1, 1, "todo", None), (2, 2, 1, "x", "y"), (3, 1, 2, None, "m")], "seq long, repo_id long, item_id long, status string, note string"), NOW)
    assert {r.id: (r.status, r.note) for r in changed.collect()} == {1: ("todo", None), 2: ("doing", "m"), 3: ("todo", None)}
    keys = W.set_state(state, spark.createDataFrame([(1, 1, "k", "v"), (2, 1, "k", None), (3, 2, "z", "q")], "seq long, list_id long, key string, value string"))
    assert {tuple(r) for r in keys.collect()} == {(1, "own", "x"), (2, "k", "theirs"), (2, "z", "q")}
    l, i, s = W.move(lists, items, state, 1, 2)
    assert {(r.id, r.repo_id) for r in l.collect()} == {(2, 2), (3, 2)} and {r.list_id for r in i.collect()} == {2} and {tuple(r) for r in s.collect()} == {(2, "k", "theirs"), (2, "own", "x")}
    nested = W.work_lists(lists, items, state, everything=True)
    assert [x.item_id for x in nested.where("id = 1").first()["items"]] == [2, 1] and W.work_lists(lists, items, state).count() == 2
    text = W.render(nested, 50 + 7200).where("id = 1").first().text
    assert text == "a (2h)\n  [doing] #2 t2 (n)\n  [done] #1 t1"
    assert W.close(lists, spark.createDataFrame([(1, 3, False), (2, 1, True)], "seq long, list_id long, open boolean"), NOW).where("closed_at is null").count() == 2
    twice = W.close(lists, spark.createDataFrame([(2, 3, True), (1, 3, False)], "seq long, list_id long, open boolean"), NOW)
    assert twice.count() == lists.count() and twice.where("id = 3").first().closed_at is None and twice.where("id = 3").first().updated_at == NOW


def test_age_of_half_lives():
    assert math.isclose(K.HALF_LIFE_DAYS, 29.0)


def test_remembering_checks_and_scores(spark):
    notes, vectors = table(spark, [note(4)]), spark.createDataFrame([(4, 0, [1.0, 0.0])], "note_id long, part long, embedding array<float>")
    anchors = spark.createDataFrame([], "note_id long, seq int, repo_id long, relpath string, start_line int, end_line int, hash string")
    files = spark.createDataFrame([(1, "a.rs", "h")], "repo_id long, relpath string, hash string")
    rows = [(1, 1, "fact", "x", None, None, "agent", [0.0, 1.0], [("a.rs", 1, 2)]), (2, None, "fact", "y", 10.0, 10.0, "capture", [0.0, 1.0], []), (3, 1, "what", "z", None, None, "agent", [1.0, 0.0], []), (4, 1, "fact", "w", None, None, "agent", [1.0, 0.0], [("gone.rs", None, None)])]
    commands = spark.createDataFrame(rows, "seq long, repo_id long, kind string, content string, pain double, cost double, source string, embedding array<float>, anchors array<struct<relpath:string,start_line:int,end_line:int>>")
    after, placed, tied, rejected = N.remember(notes, vectors, anchors, commands, files, NOW)
    got = {r.id: r for r in after.collect()}
    assert set(got) == {4, 5, 6} and got[5].salience == pytest.approx(0.25 + 0.12) and got[6].salience == pytest.approx(0.75)
    assert {(r.note_id, r.part) for r in placed.collect()} == {(4, 0), (5, 1), (6, 0)} and [(r.note_id, r.hash) for r in tied.collect()] == [(5, "h")]
    assert {r.seq for r in rejected.collect()} == {3, 4}
    lines = N.stale_lines(N.stale_list(N.mark_stale(after, spark.createDataFrame([(5,)], "note_id long"), NOW), tied))
    assert lines.first().line == "5\tfact\ta.rs\tx"
