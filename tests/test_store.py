"""The kept store: commits touch their buckets only, equal a full rebuild, and come again without harm."""

import glob
import os

from quillstone.functions.hashing import xxh64_hex
from quillstone.operators import ingest as I
from quillstone.operators import lexicon as L
from quillstone.operators import search as S
from quillstone.operators.store import SCHEMAS, Store
from quillstone.streaming import jobs
from pyspark.sql import functions as F

FILES = "repo_key string, relpath string, content string, mtime_ms long"
PATHS = "repo_key string, relpath string"


def text(k, tail=""):
    return f"fn f{k}() {{\n    a();\n    b();\n    c();\n}}\n{tail}"


def rows(spark, files):
    return spark.createDataFrame([("r", p, c, 1) for p, c in files.items()], FILES)


def note(spark, *ids):
    named = {"id": F.col("id"), "status": F.lit("live"), "kind": F.lit("fact")}
    types = dict(c.split() for c in SCHEMAS["notes"].split(", "))
    return spark.createDataFrame([(i,) for i in ids], "id long").select(*[named.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def test_commits_equal_a_full_rebuild(spark, tmp_path):
    folder, embedder, none = str(tmp_path / "s"), I.HashEmbedder(8), spark.createDataFrame([], PATHS)
    store = Store(spark, folder, 8)
    assert store.latest().version == 0 and store.table("chunks").count() == 0
    files = {f"d/f{k}.rs": text(k) for k in range(20)}
    store.put("notes", note(spark, 1, 2, 3))
    hashed = rows(spark, files).select("repo_key", "relpath", xxh64_hex(F.col("content")).alias("hash"))
    store.put("anchors", hashed.where("relpath in ('d/f3.rs', 'd/f4.rs')").withColumn("note_id", F.when(F.col("relpath") == "d/f3.rs", 1).otherwise(2).cast("long")), whole_keys=False)
    first = store.commit(rows(spark, files), none, embedder, 100, 0)
    assert first.last_chunk == 20 and store.table("notes").where("status = 'stale'").count() == 0

    before = set(glob.glob(f"{folder}/data/*/v=*/bucket=*"))
    second = store.commit(rows(spark, {"d/f3.rs": text(3, "// more\n")}), spark.createDataFrame([("r", "d/f4.rs")], PATHS), embedder, 200, 1)
    wrote = {p.split("/data/")[1] for p in set(glob.glob(f"{folder}/data/*/v=*/bucket=*")) - before}
    assert all(f"v={second.version}/" in p for p in wrote) and sum(p.startswith("files/") for p in wrote) <= 2 and sum(p.startswith("notes/") for p in wrote) == 1 and sum(p.startswith("vectors/") for p in wrote) == 1
    assert {(r.id, r.status, r.stale_at) for r in store.table("notes").collect()} == {(1, "stale", 200), (2, "live", None), (3, "live", None)}

    # A batch that comes again, and one that was broken off before its mark.
    assert store.commit(rows(spark, {"d/f9.rs": "x"}), none, embedder, 300, 1) == second
    os.makedirs(f"{folder}/data/files/v={second.version + 1}/bucket=0")
    after = {**files, "d/f3.rs": text(3, "// more\n"), "d/new.rs": text(99)}
    del after["d/f4.rs"]
    third = store.commit(rows(spark, {"d/new.rs": text(99)}), none, embedder, 300, 2)
    rebuilt, _ = I.sync(I.empty_snapshot(spark), rows(spark, after), none, embedder)
    part = ["repo_key", "relpath", "seq", "start_line", "end_line", "symbol", "content", "content_hash", "embedding", "mtime_ms"]
    plain = lambda df: sorted(map(str, df.select(*part).collect()))
    assert plain(store.searchable()) == plain(rebuilt.chunks)
    assert sorted(map(tuple, store.table("files").collect())) == sorted(map(tuple, rebuilt.files.select(*store.table("files").columns).collect()))
    ids = [r.chunk_id for r in store.table("chunks").collect()]
    assert len(set(ids)) == len(ids) == 20 and max(ids) == third.last_chunk == 22
    # Earlier versions stay as they were.
    assert store.table("files", store.latest(first.version)).count() == 20 and store.table("chunks", store.latest(first.version)).where("content like '%more%'").count() == 0


def test_a_stream_of_commits(spark, tmp_path):
    store, source = Store(spark, str(tmp_path / "s"), 4), tmp_path / "in"
    source.mkdir()
    for k, files in enumerate([{"a.rs": text(1), "b.rs": text(2)}, {"a.rs": text(3)}]):
        rows(spark, files).withColumn("deleted", F.lit(False)).coalesce(1).write.json(str(tmp_path / f"x{k}"))
        (part,) = glob.glob(str(tmp_path / f"x{k}" / "part-*.json"))
        os.rename(part, source / f"{k}.json")
        jobs.store_stream(jobs.uploads(spark, str(source)), store, I.HashEmbedder(8), lambda: 7, str(tmp_path / "c"), {"availableNow": True}).awaitTermination()
    assert {(r.relpath, r.symbol) for r in store.table("chunks").collect()} == {("a.rs", "f3"), ("b.rs", "f2")} and store.latest().batch == 1


def test_the_lexical_index_follows_commits(spark, tmp_path):
    """Segments with gone chunks, and one merged segment, find what an index of the live chunks finds."""
    store, embedder, none = Store(spark, str(tmp_path / "s"), 4), I.HashEmbedder(4), spark.createDataFrame([], PATHS)
    store.commit(rows(spark, {f"d/f{k}.rs": text(k, "// back_off retry\n" * (k % 3)) for k in range(12)}), none, embedder, 1)
    store.commit(rows(spark, {"d/f1.rs": text(1, "// nothing\n"), "e/new.rs": text(50, "// back_off\n")}), spark.createDataFrame([("r", "d/f2.rs")], PATHS), embedder, 2)
    queries = spark.createDataFrame([(1, "back_off"), (2, "retr f7"), (3, "nothing zzz"), (4, "")], "query_id long, query string")
    plain = lambda df: sorted((r.query_id, r.chunk_id, r.score, r.rank) for r in df.collect())
    for of in ({}, {"prefix": "D/"}, {"few": 0}):
        want = plain(S.lexical(queries, store.table("chunks"), 5, prefix=of.get("prefix")))
        assert plain(L.search_index(queries, store.index(), 5, **of)) == want and want
    merged = store.merge()
    assert plain(L.search_index(queries, store.index(), 5)) == plain(S.lexical(queries, store.table("chunks"), 5))
    assert [v for (t, _), v in merged.at.items() if t == "segments"] == [merged.version] and store.index().entries.where("term = 'f2'").count() == 0
    assert plain(L.search_index(queries, Store(spark, str(tmp_path / "none"), 4).index(), 5)) == []
