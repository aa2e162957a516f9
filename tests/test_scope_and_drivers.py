"""Search scope, reranking pool, staleness on commit, offsets, drivers and the command line."""

import pytest
from pyspark.sql import functions as F

from quillstone import constants as K
from quillstone.operators import capture as C
from quillstone.operators import evaluation as E
from quillstone.operators import ingest as I
from quillstone.operators import notes as N
from quillstone.operators import search as S
from quillstone.streaming import jobs

WORDS = ["alpha parser", "beta tokens", "gamma walker", "delta parser"]


@pytest.fixture(scope="module")
def chunks(spark):
    e = I.HashEmbedder(16)
    rows = [(i, "r1" if i % 2 else "r2", f"src/f{i}.py", 1, 9, f"make_{w.split()[0]}", f"{w} " * 3 + f"text {i}", 0, e.embed([w])[0]) for i, w in enumerate(WORDS)]
    return spark.createDataFrame(rows, "chunk_id long, repo_key string, relpath string, start_line int, end_line int, symbol string, content string, mtime_ms long, embedding array<float>")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "where is the parser made", I.HashEmbedder(16).embed(["parser"])[0])], "query_id long, query string, embedding array<float>")


def test_scope():
    assert S.resolve_scope("x", "/home/me", "/home/me", "y") == "x"
    assert S.resolve_scope(None, "/home/me/", "/home/me", "y") is None and S.resolve_scope(None, "/", "/home/me", "y") is None
    assert S.resolve_scope(None, "/home/me/code", "/home/me", "y") == "y" and S.resolve_scope(None, "/home/m", "/home/me", "y") == "y"
    assert S.pool_size(5, None) == 5 and S.pool_size(5, max) == K.RERANK_TOP and S.pool_size(50, max) == 50 and S.pool_size(5, max, wanted=False) == 5


def test_search_in_a_repository(spark, queries, chunks):
    everywhere = {r.chunk_id for r in S.hybrid_search(queries, chunks, 0).collect()}
    own = {r.chunk_id for r in S.hybrid_search(queries, chunks, 0, repo_key="r1", dim=16).collect()}
    assert everywhere == {0, 1, 2, 3} and own == {1, 3}
    with pytest.raises(LookupError):
        S.hybrid_search(queries, chunks, 0, repo_key="r3")


def test_statistics_are_of_all_repositories(queries, chunks):
    score = lambda **kw: {r.chunk_id: r.score for r in S.lexical(queries, chunks, 9, **kw).collect()}
    whole, part = score(), score(scope=F.col("repo_key") == "r1")
    assert set(part) < set(whole) and all(whole[k] == v for k, v in part.items())


def test_reranker_sees_documents(queries, chunks):
    seen = lambda q, docs: [float(d.startswith("r2 > src/f2.py > make_gamma\n")) for d in docs]
    pool = [r.chunk_id for r in S.hybrid_search(queries, chunks, 0).orderBy("pos").collect()]
    placed = sorted(pool, key=lambda c: c != 2)  # the scorer's order: the one that it knows, then the pool's
    fused = sorted(pool, key=lambda c: -(1 / (K.RRF_K + 1 + pool.index(c)) + K.RERANK_WEIGHT / (K.RRF_K + 1 + placed.index(c))))
    hits = S.search_reranked(queries, chunks, 0, seen, limit=4).orderBy("pos").collect()
    assert [r.chunk_id for r in hits] == fused != pool and "document" not in hits[0].asDict()
    assert S.search_reranked(queries, chunks, 0, None, limit=2).count() == 2


def test_rerank_document_is_cut_between_characters(spark):
    got = spark.range(1).select(S.rerank_document(F.lit("r"), F.lit("p"), F.lit(None).cast("string"), F.lit("é" * 3000)).alias("d")).first().d
    assert len(got.encode()) in (K.RERANK_BYTES - 1, K.RERANK_BYTES) and got.startswith("r > p\né")


def test_scope_counts(spark):
    files = spark.createDataFrame([("a", 2), ("a", 3)], "repo_key string, chunk_count long")
    got = S.scope_counts(files, spark.createDataFrame([("a",), ("b",)], "repo_key string")).collect()
    assert {r.repo_key: r.chunks for r in got} == {"a": 5, "b": 0}


def test_offsets(spark):
    state = spark.createDataFrame([("s", 7), ("t", 2)], "session string, offset long")
    lines = spark.createDataFrame([("s", 3), ("t", 4), ("u", 1)], "session string, line_no int")
    assert {tuple(r) for r in C.commit_offsets(state, lines).collect()} == {("s", 7), ("t", 4), ("u", 1)}
    marked = spark.createDataFrame([("s", 1)], "session string, note_id long")
    assert C.commit_marks(marked, marked).count() == 1


def test_offset_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), []
    spark.createDataFrame([("s", 3), ("s", 5), ("t", 1)], "session string, line_no int").coalesce(1).write.json(source)
    stream = jobs.offsets(spark.readStream.schema("session string, line_no int").json(source))
    q = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(out) == [("s", 5), ("t", 1)]


def test_commit_comes_before_staleness(spark):
    done = []
    apply = jobs.then_stale(lambda up, gone: done.append("commit"), lambda files: done.extend(sorted(r.relpath for r in files.collect())))
    apply(spark.createDataFrame([("r", "a.py", "x", 1)], "repo_key string, relpath string, content string, mtime_ms long"), spark.createDataFrame([("r", "b.py")], "repo_key string, relpath string"))
    assert done == ["commit", "a.py"]


@pytest.mark.parametrize("target", [None, 9])
def test_prune_takes_what_is_tied(spark, target):
    notes = spark.createDataFrame([(1, "live", None), (2, "archived", None), (3, "live", None)], "id long, status string, superseded_by long")
    vectors = spark.createDataFrame([(1, 7, [1.0]), (2, 7, [1.0]), (3, 8, [1.0])], "note_id long, part long, embedding array<float>")
    mute = spark.createDataFrame([(1, 7, 0), (1, 9, 0), (3, 7, 0)], "note_id long, repo_id long, created_at long")
    anchors = spark.createDataFrame([(1, 7), (3, 8)], "note_id long, repo_id long")
    v, m, a = N.prune_tied(notes, vectors, mute, anchors, 7, target)
    assert {(r.note_id, r.part) for r in v.collect()} == {(1, target or 0), (3, 8)}
    assert sorted((r.note_id, r.repo_id) for r in m.collect()) == ([(1, 9)] if target is None else [(1, 9), (3, 9)])
    assert sorted(map(tuple, a.collect())) == ([(3, 8)] if target is None else [(1, 9), (3, 8)])


def test_evaluation_driver(spark, queries, chunks):
    cases = queries.select(F.lit(0).alias("case_no"), "query_id", "query", "embedding", F.array(F.lit("src/f3.py")).alias("expect"))
    search = lambda c: S.hybrid_search(c.select("query_id", "query", "embedding"), chunks, 0).select(F.lit(0).alias("case_no"), "pos", "relpath", "start_line", "end_line")
    runs, low_high = E.evaluate(cases, search, runs=2)
    assert [(r.run, r.cases, r.recall) for r in runs.orderBy("run").collect()] == [(1, 1, 1.0), (2, 1, 1.0)]
    spread = low_high.first()
    assert spread.recall_low == spread.recall_high == 1.0 and spread.mrr_low == spread.mrr_high


def test_calibration_driver(spark):
    class Verifier:
        def ask(self, question, claim, evidence):
            return {"good": 0.9, "bad": 0.2}[claim]

    pairs = spark.createDataFrame([("good", "e", True), ("bad", "e", False), ("unknown", "e", True)], "claim string, evidence string, label boolean")
    r = E.calibrate(pairs, Verifier()).first()
    assert (r.false_accepts, r.false_rejects, r.worst_negative, r.auroc) == (0, 1, 0.2, 0.5)
