"""Requests of a sync, places in an order and superseding in order, against one-by-one versions."""

import random

import pytest

from quillstone.functions.keeping import with_position
from quillstone.operators import notes as N
from quillstone.operators.batches import sync_batches, sync_requests

FILES = "repo_key string, relpath string, size long, tag string"


def one_by_one(files, most, limit):
    """The loop over files in path order: a request is sent before a file that does not go into it."""
    out = {}
    for repo in {f[0] for f in files}:
        batch = n = total = 0
        for _, path, size, _ in sorted(f for f in files if f[0] == repo):
            if n >= most or total + (size or 0) > limit:
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + (size or 0)
            out[repo, path] = batch
    return out


@pytest.mark.parametrize("span", [16, 50, 4096])
def test_requests_are_cut_as_one_by_one(spark, span):
    rng = random.Random(span)
    files = [(repo, f"p{k:05d}", rng.choice([0, 1, 10, 400, 999, 1000, 1001, 5000, rng.randrange(300)]), "x") for repo, n in (("big", 3000), ("small", 3), ("one", 1), ("run", 300)) for k in range(n)]
    files = [(r, p, 0 if r == "run" else s, t) for r, p, s, t in files if r != "one"] + [("one", "a", 5000, "x")]
    files += [("first", "a", 1001, "x"), ("first", "b", 1, "x"), ("empty", "n", 0, None)]
    got = sync_batches(spark.createDataFrame(files, FILES).repartition(7), 16, 1000, span)
    assert got.columns[:4] == ["repo_key", "relpath", "size", "tag"]
    assert {(r.repo_key, r.relpath): r.batch for r in got.collect()} == one_by_one(files, 16, 1000)
    sums = {}
    for r in got.collect():
        sums.setdefault((r.repo_key, r.batch), []).append(r.size)
    assert all(len(s) <= 16 and (sum(s) <= 1000 or len(s) == 1) for s in sums.values())


def test_deletes_go_with_the_first_request(spark):
    files = spark.createDataFrame([("r", "a", 3 << 20, None), ("r", "b", 1, None)], FILES)
    deletes = spark.createDataFrame([("r", "x"), ("gone", "y")], "repo_key string, relpath string")
    assert {tuple(r) for r in sync_requests(files, deletes).collect()} == {("r", 1, "a", "upsert"), ("r", 2, "b", "upsert"), ("r", 0, "x", "delete"), ("gone", 0, "y", "delete")}
    assert sync_batches(spark.createDataFrame([], FILES)).count() == 0


def test_positions(spark):
    rows = [(g, k) for g, n in (("a", 500), ("b", 1), ("c", 40)) for k in range(n)]
    got = with_position(spark.createDataFrame(rows, "g string, k int").repartition(5), ["g"], ["k"])
    assert got.columns == ["g", "k", "position"] and all(r.position == r.k for r in got.collect()) and got.count() == len(rows)


@pytest.mark.parametrize("at_once", [0, 5, 10_000])
def test_commands_supersede_as_one_by_one(spark, at_once):
    rng = random.Random(at_once + 1)
    notes = [(k, k % 7 if k % 9 == 0 else None) for k in range(60)]
    commands = [(10 * s, rng.randrange(62), rng.randrange(62)) for s in range(150)] + [(3, 1, 2), (4, 2, 1), (5, 2, 5), (6, 5, 8), (7, 8, 8), (8, None, 3)]
    free, want = {k for k, by in notes if by is None}, set()
    for _, old, new in sorted(commands, key=lambda c: c[0]):
        if old != new and old in free and new in free:
            free.discard(old)
            want.add((new, old))
    after, links = N.supersede(spark.createDataFrame(notes, "id long, superseded_by long"), spark.createDataFrame(commands, "seq long, old_id long, new_id long"), at_once)
    assert {(r.note_id, r.related_id) for r in links.collect()} == want and (2, 1) in want and (1, 2) not in want
    assert {r.id for r in after.where("superseded_by is null").collect()} == free
