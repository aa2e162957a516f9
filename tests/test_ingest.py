"""Chunks, manifests and syncs."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import chunking as C
from quillstone.operators import ingest as I
from quillstone.sources import records as R


@pytest.mark.parametrize(
    "spans,out",
    [
        ([(0, 2, None), (2, 10, "alpha")], [(0, 10, "alpha")]), ([(0, 10, "alpha"), (10, 11, None)], [(0, 11, "alpha")]),
        ([(0, 1, "a"), (1, 2, "b"), (2, 3, "c"), (3, 4, "d"), (4, 12, "e")], [(0, 4, None), (4, 12, "e")]), ([(0, 2, "S > a"), (2, 5, "S > b")], [(0, 5, "S")]), ([(0, 1, None)], [(0, 1, None)]), ([], []),
    ],
)
def test_short_spans_join(spans, out):
    assert C.coalesce(spans) == out


def test_windows_cover_all_lines():
    assert C.windows(["x"] * 3) == [(0, 3, None)] and C.windows([]) == [] and C.windows([" "] * 5) == []
    lines = ["x"] * 60
    lines[37] = ""
    assert C.windows(lines) == [(0, 37, None), (27, 60, None)]
    spans = C.windows(["x"] * 100)
    assert spans[0] == (0, 40, None) and spans[-1][1] == 100 and all(b[0] == a[1] - 10 for a, b in zip(spans, spans[1:]))


def test_files_to_chunks():
    assert C.chunk_file("a.py", "# @generated\nx = 1") == [] and C.chunk_file("a.py", "x\0") == [] and C.chunk_file("a.txt", None) == []
    source = "import os\n\n\n# makes one\n@cached\ndef alpha():\n    a = 1\n    b = 2\n    return a\n\n\nclass Beta:\n    def one(self):\n        return 1\n\n    def two(self):\n        return 2\n"
    chunks = C.chunk_file("a.py", source)
    assert [(c["start_line"], c["end_line"], c["symbol"]) for c in chunks] == [(1, 9, "alpha"), (12, 17, "Beta")]
    rust = "use x;\n\n/// doc\npub fn one() {\n    let s = \"}\";\n    a();\n    b();\n}\n\nimpl Store {\n" + "".join(f"    fn m{i}(&self) {{\n" + "        x();\n" * 40 + "    }\n" for i in range(4)) + "}\n"
    assert [c["symbol"] for c in C.chunk_file("a.rs", rust)] == ["one", "Store > m0", "Store > m1", "Store > m2", "Store > m3"]
    assert C.chunk_file("a.md", "a\r\nb\n")[0]["content"] == "a\nb"


class Counting(I.HashEmbedder):
    pass


FILES = "repo_key string, relpath string, content string, mtime_ms long"


def upload(spark, **files):
    return spark.createDataFrame([("r", p.replace("__", "/").replace("_rs", ".rs"), c, 1_700_000_000_000) for p, c in files.items()], FILES)


def test_sync_reuses_vectors(spark):
    none = spark.createDataFrame([], "repo_key string, relpath string")
    one, two = "fn load() {\n    a();\n    b();\n}\n", "fn send() {\n    c();\n    d();\n}\n\nfn back_off() {\n    e();\n    f();\n}\n"
    state, first = I.sync(I.empty_snapshot(spark), upload(spark, src__config_rs=one, src__net_rs=two), none, I.HashEmbedder())
    first = first.first()
    assert (first.indexed, first.deleted, first.reused, first.embedded) == (2, 0, 0, 3)
    ids = [r.chunk_id for r in state.chunks.orderBy("chunk_id").collect()]
    assert ids == [1, 2, 3]
    again, second = I.sync(state, upload(spark, src__net_rs=two.replace("e();", "z();")), none, I.HashEmbedder())
    second = second.first()
    assert (second.embedded, second.reused) == (1, 1)
    assert sorted(r.chunk_id for r in again.chunks.collect()) == [1, 4, 5]
    gone, third = I.sync(again, spark.createDataFrame([], FILES), spark.createDataFrame([("r", "src/net.rs")], "repo_key string, relpath string"), I.HashEmbedder())
    assert third.first().deleted == 1 and {r.relpath for r in gone.chunks.collect()} == {"src/config.rs"} and gone.files.count() == 1


def test_manifests(spark):
    disk, stored = (spark.createDataFrame(x, "relpath string, hash string") for x in ([("a", "1"), ("b", "2"), ("c", "3")], [("b", "2"), ("c", "0"), ("d", "4")]))
    assert {tuple(r) for r in I.manifest_diff(disk, stored).collect()} == {("a", "upsert"), ("b", "unchanged"), ("c", "upsert"), ("d", "delete")}
    assert I.manifest_diff(disk, stored, full=True).where("action = 'unchanged'").count() == 0


def test_embedding_is_checked_and_tried_again(spark):
    class Bad:
        dim = 3

        def embed(self, texts):
            return [[1.0]] * len(texts)

    with pytest.raises(Exception, match="count or dimension"):
        spark.range(1).select(I.embed_with(Bad())(F.lit("x"))).collect()
    v = I.HashEmbedder(8).embed(["One one two", ""])
    assert sum(x * x for x in v[0]) == pytest.approx(1) and sum(v[1]) == 0


def test_files_are_read(spark, tmp_path):
    for name, data in {"a.txt": b"one", "x/b.rs": b"fn a() {}", "x/.hidden": b"n", "c.lock": b"n", "empty.txt": b"", "bad.txt": b"\xff\xfe", "big.txt": b"x" * 2000}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = R.read_files(spark, str(tmp_path), max_bytes=1000)
    assert {r.relpath: r.content for r in rows.collect()} == {"a.txt": "one", "x/b.rs": "fn a() {}"}
    kept = rows.where(~R.ignore_rules(["# none", "x/", "!x/b.rs"]))
    assert {r.relpath for r in kept.collect()} == {"a.txt", "x/b.rs"} and rows.where(~R.ignore_rules(["*.rs"])).count() == 1


def test_golden_sets_are_read(spark, tmp_path):
    (tmp_path / "g.toml").write_text('[meta]\nrepo = "r"\n[[case]]\nquery = "q"\nexpect = ["a.rs:3"]\n[[case]]\nquery = "p"\nexpect = ["b"]\npath_prefix = "src/"\n')
    rows = R.read_golden(spark, str(tmp_path / "g.toml")).collect()
    assert [(r.case_no, r.query, r.expect, r.path_prefix) for r in rows] == [(0, "q", ["a.rs:3"], None), (1, "p", ["b"], "src/")]


def test_indexing_is_planned_and_snapshots_are_kept(spark, tmp_path):
    state, _ = I.sync(I.empty_snapshot(spark), upload(spark, a_rs="fn a() {}\n", b_rs="fn b() {}\n"), spark.createDataFrame([], "repo_key string, relpath string"), I.HashEmbedder(8))
    I.write_snapshot(state, str(tmp_path), 1)
    state = I.read_snapshot(spark, str(tmp_path), 1)
    uploads, deletes, counts = I.plan_index(upload(spark, a_rs="fn a() {}\n", c_rs="fn c() {}\n"), state)
    assert {r.relpath for r in uploads.collect()} == {"c.rs"} and {r.relpath for r in deletes.collect()} == {"b.rs"} and tuple(counts.first()) == (1, 1, 1)
    with pytest.raises(ValueError, match="at most"):
        I.plan_index(upload(spark, a_rs="x", c_rs="y"), state, max_files=1)
    assert I.prune(state, "r").chunks.count() == 0
    q = spark.createDataFrame([(1, "one"), (2, "one"), (3, "two")], "query_id long, query string")
    told, memo = I.query_vectors(q, spark.createDataFrame([("two", [9.0])], "query string, embedding array<float>"), I.HashEmbedder(8))
    assert told.count() == 3 and memo.count() == 2 and told.where("query_id = 3").first().embedding == [9.0]
