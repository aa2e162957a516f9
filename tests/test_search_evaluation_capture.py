"""Search end to end, evaluation, transcripts and streams."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import capture as C
from quillstone.operators import evaluation as E
from quillstone.operators import search as S
from quillstone.operators.ingest import HashEmbedder
from quillstone.plans import queries as P
from quillstone.sources import models
from quillstone.sources.records import read_lines
from quillstone.streaming import jobs

NOW = 1_700_000_000_000
CHUNK = "chunk_id long, relpath string, start_line int, end_line int, symbol string, content string, mtime_ms long, embedding array<float>"


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["load the configuration file from disk", "load the configuration file from disk again", "send an http request and back off", "parse tokens of the query", "write replace_file_chunks to the store", "fuse ranks of both legs"]
    paths = ["src/config.rs", "src/config2.rs", "src/net.rs", "lib/parse.rs", "src/store.rs", "lib/fuse.rs"]
    symbols = ["load", "load", "send", "QueryParser", "Store > replace_file_chunks", None]
    v = HashEmbedder(64).embed(texts)
    return spark.createDataFrame([(i, paths[i], 1, 9, symbols[i], t, NOW, v[i]) for i, t in enumerate(texts)], CHUNK)


def queries(spark, *texts):
    v = HashEmbedder(64).embed(list(texts))
    return spark.createDataFrame([(i, t, v[i]) for i, t in enumerate(texts)], "query_id long, query string, embedding array<float>")


def test_search_end_to_end(spark, corpus):
    q = queries(spark, "how is the configuration file loaded from the disk", "replace_file_chunks")
    hits = S.hybrid_search(q, corpus, NOW, limit=3).orderBy("query_id", "pos").collect()
    assert hits[0].relpath == "src/config.rs" and 0 < hits[0].shown <= 1
    assert [h for h in hits if h.query_id == 1][0].relpath == "src/store.rs"
    scoped = S.hybrid_search(q, corpus, NOW, path_prefix="lib/").collect()
    assert scoped and all(h.relpath.startswith("lib/") for h in scoped)


def test_phrases_prefixes_and_fields(spark, corpus):
    q = queries(spark, "replace_file_chunks", "confi", "queryparser", "con")
    hits = {}
    for h in S.lexical(q, corpus, 10).collect():
        hits.setdefault(h.query_id, []).append((h.rank, h.chunk_id))
    assert sorted(hits[0])[0][1] == 4 and len(hits[0]) == 1 and {c for _, c in hits[1]} == {0, 1} and {c for _, c in hits[2]} == {3} and 3 not in hits


def test_nearest_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    c = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame(rows[:7], "query_id long, embedding array<double>")

    def distance(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        return 1 - dot / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    for r in S.nearest(q, c, 4).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("x")).collect():
        assert [x.chunk_id for x in r.x] == [i for _, i in sorted((distance(rows[r.query_id][1], v), i) for i, v in rows)[:4]]
    assert S.nearest_adaptive(q, c, 1, 8).where("chunk_id = query_id").count() == 7 and S.nearest_coarse(q, c, 1, 8).where("chunk_id = query_id").count() == 7


def test_coarse_search_by_blocks_of_queries(spark, monkeypatch):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = v.where("chunk_id % 9 = 0").withColumnRenamed("chunk_id", "query_id")
    rows = lambda: sorted(map(tuple, S.nearest_coarse(q, v, 3, 64, 20).collect()))
    whole = rows()
    monkeypatch.setattr(S, "QUERY_BLOCK", 5)
    assert rows() == whole and len(whole) == 3 * q.count()


def test_recall_curve_over_every_twentieth_vector(spark):
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    v = np.array([r.embedding for r in rows], np.float64)
    v /= np.sqrt((v * v).sum(1))[:, None]
    asked = [i for i, r in enumerate(rows) if r.vec_id % 20 == 0]
    assert len(asked) > 10
    want = {}
    for n in (100, 200, 400, 800, 1600):
        hits = 0
        for i in asked:
            far = 1 - v @ v[i]
            far[i] = np.inf  # a vector is not its own neighbour
            near = np.argsort(((v > 0) != (v[i] > 0)).sum(1) + 1000 * (np.arange(len(v)) == i), kind="stable")[:n]
            hits += int((np.sort(far[near])[:10] <= np.sort(far)[9] + 1e-6).sum())
        want[n] = hits / (10 * len(asked))
    assert {r.coarse_k: r.recall for r in P.ann_recall_curve(spark, d).collect()} == pytest.approx(want, abs=2e-6)


def test_dropped_copies_make_room_for_hits_beyond_the_tenth(spark, tmp_path):
    others = [f"amber birch cedar {w} {w}s {w}ed {w}ing" for w in ("stone", "river", "cloud", "field")]
    texts = ["amber birch cedar"] * 12 + others + [f"filler{i}" for i in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "amber birch cedar")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted((r.pos, r.chunk_id) for r in P.near_dup_greedy(spark, str(tmp_path)).collect()) == [(0, 0), (1, 12), (2, 13), (3, 14), (4, 15)]


def test_expansions(spark):
    symbols = spark.createDataFrame([("AuthLayer",), ("Store > replace_file_chunks",), ("unrelated",), ("get_crypto_quotes",), ("domains",)], "symbol string")
    q = spark.createDataFrame([(1, "auth middleware chunks"), (2, "cry dom")], "query_id long, query string")
    assert {r.query_id: r.expansions for r in S.expand_symbols(q, symbols).collect()} == {1: ["AuthLayer", "replace_file_chunks"]}


def test_near_duplicates_go_greedily(spark):
    rows = [(1, 1, 0.9, "a1 b1 c1 d1 e1"), (1, 2, 0.8, "a1 b1 c1 d1 e1 "), (1, 3, 0.7, "x1 y1"), (1, 4, 0.6, "z1 w1"), (2, 5, 0.1, ""), (2, 6, 0.05, "!")]
    hits = spark.createDataFrame(rows, "query_id long, chunk_id long, score double, content string")
    got = {(r.query_id, r.pos, r.chunk_id) for r in S.drop_near_duplicates(hits, 2).collect()}
    assert got == {(1, 0, 1), (1, 1, 3), (2, 0, 5)}


def test_rerank_and_its_fallback(spark):
    hits = spark.createDataFrame([(1, "q", i, f"d{i}") for i in range(4)] + [(2, "bad", 0, "x"), (2, "bad", 1, "y")], "query_id long, query string, pos int, content string")

    def scorer(query, documents):
        if query == "bad":
            raise TimeoutError
        return [float(i == len(documents) - 1) * 9 + i for i in range(len(documents))]

    got = S.rerank(hits, scorer, 2, weight=100.0).orderBy("query_id", "pos").collect()
    assert [(r.query_id, r.content) for r in got] == [(1, "d3"), (1, "d2"), (2, "x"), (2, "y")]


def test_answers_and_hyde(spark):
    q = spark.createDataFrame([(1, "how does the sync protocol decide"), (2, "auth")], "query_id long, query string")
    local = spark.createDataFrame([(1, 0, "é" * 1000), (1, 9, "no")], "query_id long, pos int, content string")
    prompt = S.answer_prompts(q, local, spark.createDataFrame([(1, 0, "web")], "query_id long, pos int, content string")).first().prompt
    assert "Source 1:\n" + "é" * 800 + "\n\nSource 2:\nweb" in prompt and "no" not in prompt.split("Source")[1]

    class Chat:
        def complete(self, prompt, max_tokens):
            return "made up"

    assert {r.query_id: r.passages for r in models.hyde_inputs(q, Chat()).collect()} == {1: ["how does the sync protocol decide", "made up"], 2: ["auth"]}
    assert models.hyde_inputs(q, None).where("size(passages) = 1").count() == 2


@pytest.mark.parametrize("rows,value", [([(True, 0.9), (False, 0.1)], 1.0), ([(True, 0.5), (False, 0.5)], 0.5), ([(True, 0.9), (True, 0.3), (False, 0.5)], 0.5), ([(True, 0.9)], None)])
def test_auroc(spark, rows, value):
    assert E.auroc(spark.createDataFrame(rows, "label boolean, score double")).first().auroc == value


def test_ranks_and_percentiles(spark):
    cases = spark.createDataFrame([(0, ["a.rs:5"]), (1, ["b.rs"]), (2, ["z"])], "case_no int, expect array<string>")
    hits = spark.createDataFrame([(0, 0, "a.rs", 6, 9), (0, 1, "a.rs", 1, 5), (1, 0, "b.rs", 1, 2)], "case_no int, pos int, relpath string, start_line int, end_line int")
    ranks = E.first_ranks(cases, hits)
    assert {r.case_no: r.rank for r in ranks.collect()} == {0: 1, 1: 0, 2: None}
    s = E.summarize(ranks).first()
    assert (s.cases, s.recall, s.mrr) == (3, pytest.approx(2 / 3), pytest.approx(0.5))
    v = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert E.percentile(v, "v", 50).first().p50 == 4.0 and E.percentile(v, "v", 95).first().p95 == 8.0
    p = spark.range(1).select(E.yes_probability(F.array(F.struct(F.lit(" Yes").alias("token"), F.lit(-0.1).alias("logprob")), F.struct(F.lit("no").alias("token"), F.lit(-2.0).alias("logprob")))).alias("p")).first().p
    assert 0.8 < p < 0.9


def test_rerank_grid(spark):
    rows = spark.createDataFrame([(0, 0, 2, False), (0, 1, 0, True), (0, 2, 1, False)], "case_no int, pos int, rerank_rank int, expected boolean")
    grid = spark.createDataFrame([("fused", 1.0, 20), ("replace", 1.0, 20), ("rrf", 9.0, 20), ("replace", 1.0, 1), ("rrf", 9.0, None)], "mode string, weight double, top_n int")
    assert {(r.mode, r.top_n): r.mrr for r in E.rerank_simulation(rows, grid).collect()} == {("fused", 20): 0.5, ("replace", 20): 1.0, ("rrf", 20): 1.0, ("replace", 1): 0.5, ("rrf", None): 1.0}
    # Ranks count within the pool: of two kept candidates the better one is first whatever stands beyond them.
    rows = spark.createDataFrame([(0, 0, 9, False), (0, 1, 4, True), (0, 2, 0, False)], "case_no int, pos int, rerank_rank int, expected boolean")
    grid = spark.createDataFrame([("replace", 1.0, 2), ("rrf", 0.9, 2)], "mode string, weight double, top_n int")
    assert {r.mode: r.mrr for r in E.rerank_simulation(rows, grid).collect()} == {"replace": 1.0, "rrf": 0.5}


def transcript(tmp_path):
    def message(role, content, **more):
        return json.dumps({"type": role, "message": {"role": role, "content": content}} | more)

    lines = [
        json.dumps({"type": "mode"}), message("user", "please fix the parser of the configuration"), message("user", "meta", isMeta=True), json.dumps({"type": "attachment", "x": "notes\n[lesson #12] (stale) keep it \"short\"\n[fact #40] it is so"}),
        message("assistant", [{"type": "text", "text": "I run the tests now"}, {"type": "tool_use", "id": "c1", "name": "Bash", "input": {"command": "cargo test"}}]),
        message("user", [{"type": "tool_result", "tool_use_id": "c1", "content": "test parser_reads_all ... FAILED because of tabs " + "x" * 2000}]), message("assistant", "side", isSidechain=True),
        message("assistant", [{"type": "tool_use", "id": "c2", "name": "Edit", "input": {"file_path": "src/parse.rs"}}, {"type": "tool_use", "id": "c3", "name": "Bash", "input": {"command": "curl https://x.y/z"}}]),
        message("user", [{"type": "tool_result", "tool_use_id": "c3", "content": "the remote page says something quotable here"}]), "not json",
    ]
    (tmp_path / "s1.jsonl").write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_transcripts(spark, tmp_path):
    lines = read_lines(spark, transcript(tmp_path))
    assert lines.count() == 10 and lines.agg(F.max("line_no")).first()[0] == 10
    own = C.number(C.entries(lines)).orderBy("n").collect()
    assert [(r.n, r.kind) for r in own] == [(1, "user"), (2, "assistant"), (3, "tool_use"), (4, "tool_result"), (5, "tool_use"), (6, "tool_use"), (7, "tool_result")]
    assert own[3].body.startswith("...") and len(own[3].body) == 1503 and own[3].provable and not own[6].provable and own[6].echoed and own[6].body == "[web content omitted]" and own[4].edited == "src/parse.rs"
    assert [r.n for r in C.number(C.entries(lines), 5).orderBy("n").collect()] == [1, 2, 3, 4]
    facts = C.reducers(C.number(C.entries(lines))).first()
    assert (facts.first_prompt, facts.tool_calls, facts.edited) == ("please fix the parser of the configuration", 3, ["src/parse.rs"])
    assert {(r.note_id, r.kind, r.content) for r in C.injected_notes(lines).collect()} == {(12, "lesson", 'keep it "short"'), (40, "fact", "it is so")}
    text = C.render(C.number(C.entries(lines)), 300).first().text
    assert text.startswith("[#1] user: please") and "\n[... entries #3-#4 omitted ...]\n[#5] " in text and len(text.replace("[... entries #3-#4 omitted ...]\n", "")) <= 300


def test_proofs_and_plans(spark):
    own = spark.createDataFrame([("s", 1, "user", "we  always use\nfour spaces here", True, False, "a.rs"), ("s", 2, "tool_result", "quote of twenty characters or more", False, False, None)], "session string, n int, kind string, body string, provable boolean, echoed boolean, edited string")
    claims = spark.createDataFrame(
        [("s", 1, "convention", 1, "always use four spaces", "c" * 400, ["a.rs:3", "b.rs"], 5), ("s", 2, "fact", 2, "quote of twenty characters", "two", [], None), ("s", 3, "fact", 1, "short", "two", [], 7)]
        + [("s", k, "decision", 1, "always use four spaces", f"n{k}", [], None) for k in range(4, 9)],
        "session string, claim_no int, kind string, entry int, quote string, content string, anchors array<string>, supersedes long",
    )
    proven = C.proofs(claims, own)
    assert {r.claim_no for r in proven.where("proven").collect()} == {1, 4, 5, 6, 7, 8}
    rows = {r.claim_no: r for r in C.plan(C.settle(proven, own)).collect()}
    assert set(rows) == {1, 2, 3, 4, 5} and (rows[1].kind, rows[1].anchors, len(rows[1].content), rows[1].supersedes) == ("convention", ["a.rs:3"], 300, 5) and rows[2].kind == "episode"
    assert rows[1].evidence == "[#1] always use four spaces" and rows[1].source.startswith("we  always") and (rows[3].kind, rows[3].anchors, rows[3].evidence, rows[3].supersedes) == ("episode", [], None, None)
    shown, stale = spark.createDataFrame([("s", 5), ("s", 6)], "session string, note_id long"), spark.createDataFrame([("s", 6, "old"), ("s", 8, "older")], "session string, note_id long, content string")
    own = own.union(spark.createDataFrame([("s", 3, "tool_result", "a result of twenty characters or more", True, False, None)], own.schema))
    votes = spark.createDataFrame([("s", 5, True, 1, "always use four spaces"), ("s", 5, False, 1, "always use four spaces"), ("s", 6, False, 1, "always use four spaces"), ("s", 5, True, 3, "result of twenty characters")], "session string, note_id long, helpful boolean, entry int, quote string")
    assert sorted((r.note_id, r.helpful) for r in C.proven_votes(votes, own, shown, stale).collect()) == [(5, False), (5, True)]
    again = spark.createDataFrame([("s", 1, 8, 3, "result of twenty characters"), ("s", 2, 8, 3, "result of twenty characters or"), ("s", 3, 6, 1, "always use four spaces")], "session string, claim_no int, note_id long, entry int, quote string")
    none = C.replaceable(C.plan(C.settle(proven, own)), shown, stale)
    assert [(r.note_id, r.content, r.evidence) for r in C.reaffirmable(again, own, stale, none).collect()] == [(8, "older", "[#3] result of twenty characters")]
    assert {r.claim_no: r.supersedes for r in none.collect()} == {1: 5, 2: None, 3: None, 4: None, 5: None}


def test_streams(spark, tmp_path):
    folder, seen = tmp_path / "in", {}
    folder.mkdir()

    def write(name, *rows):
        (folder / name).write_text("\n".join(json.dumps(dict(zip(("repo_key", "relpath", "content", "mtime_ms", "deleted"), r))) for r in rows))

    def apply(upserts, deletes):
        seen.update({r.relpath: r.content for r in upserts.collect()})
        for r in deletes.collect():
            seen.pop(r.relpath, None)

    write("1.json", ("r", "a", "old", 1, False), ("r", "a", "new", 2, False), ("r", "b", "x", 1, False))
    for _ in range(2):  # a second run goes on from the checkpoint
        jobs.sync_stream(jobs.uploads(spark, str(folder)), apply, str(tmp_path / "ck"), {"availableNow": True}).awaitTermination(120)
        write("2.json", ("r", "b", "", 3, True))
    assert seen == {"a": "new"}
    assert jobs.gc_due(str(tmp_path / "stamp"), 1000.0) and not jobs.gc_due(str(tmp_path / "stamp"), 2000.0) and jobs.gc_due(str(tmp_path / "stamp"), 90_000.0)


def test_votes_are_counted_once(spark, tmp_path):
    folder = tmp_path / "votes"
    folder.mkdir()
    rows = [{"note_id": 1, "seq": s, "ts": 10 * s, "helpful": s % 2 == 1} for s in (1, 2, 3)]
    (folder / "1.json").write_text("\n".join(map(json.dumps, [*rows, rows[0], {"note_id": 2, "seq": 4, "ts": 5, "helpful": False}])))
    stream = spark.readStream.schema("note_id long, seq long, ts long, helpful boolean").json(str(folder))
    jobs.votes(stream).writeStream.outputMode("update").format("memory").queryName("votes").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination(120)
    assert {tuple(r) for r in spark.table("votes").collect()} == {(1, 2, 1, 30), (2, 0, 1, 0)}


def test_bursts(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00.000"), (1, "2024-01-01 00:00:00.300"), (1, "2024-01-01 00:00:02.000"), (2, "2024-01-01 00:00:00.000")], "user_id long, t string").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r.user_id, r.n) for r in jobs.bursts(rows).collect()) == [(1, 1), (1, 2), (2, 1)]


def test_reranking_is_remembered(spark):
    hits = spark.createDataFrame([(1, "q", i, 10 + i, f"d{i}") for i in range(3)], "query_id long, query string, pos int, chunk_id long, content string")
    memo = spark.createDataFrame([], "key string, order array<long>")
    calls = spark.sparkContext.accumulator(0)

    def scorer(query, documents):
        calls.add(1)
        return [float(i) for i in range(len(documents))]

    first, memo = S.rerank_memo(hits, memo, scorer, 2, weight=100.0)
    memo = spark.createDataFrame(memo.collect(), memo.schema)
    n = calls.value
    again, _ = S.rerank_memo(hits, memo, scorer, 2, weight=100.0)
    assert [r.chunk_id for r in first.orderBy("pos").collect()] == [12, 11] == [r.chunk_id for r in again.orderBy("pos").collect()] and n > 0


def test_plans_become_commands(spark):
    planned = spark.createDataFrame([("s", 1, "fact", "c", ["a"], 2, "quote", 12), ("s", 2, "fact", "d", [], 2, "quote", 99)], "session string, claim_no int, kind string, content string, anchors array<string>, entry int, quote string, supersedes long")
    shown = spark.createDataFrame([("s", 12), ("s", 13)], "session string, note_id long")
    votes = spark.createDataFrame([("s", 13, True, True), ("s", 12, False, False), ("s", 77, True, True)], "session string, note_id long, helpful boolean, proven boolean")
    remember, supersede, vote = C.plan_commands(planned, shown, votes)
    assert {r.evidence for r in remember.collect()} == {"[#2] quote"} and [(r.claim_no, r.old_id) for r in supersede.collect()] == [(1, 12)] and [(r.note_id, r.helpful) for r in vote.collect()] == [(13, True)]
    scores = spark.createDataFrame([("s", 1, 0.9)], "session string, claim_no int, score double")
    assert {r.claim_no: r.kind for r in C.verify_gate(planned, scores).collect()} == {1: "fact", 2: "episode"} and C.verify_gate(planned, None) is planned
    due = C.due_sessions(spark.createDataFrame([("s", 3), ("t", 2)], "session string, tool_calls long"), spark.createDataFrame([("s", 40)], "session string, offset long"))
    assert [(r.session, r.offset) for r in due.collect()] == [("s", 40)]
    text = C.prompts(spark.createDataFrame([("s", "T")], "session string, text string"), spark.createDataFrame([("s", 1, "fact", "x")], "session string, note_id long, kind string, content string"), spark.createDataFrame([], "session string, note_id long, kind string, content string")).first().prompt
    assert text == "Existing notes:\n- #1 [fact] x\n\nTranscript:\nT"
    assert spark.range(1).select(C.repo_relative(F.lit("/r/a/b"), F.lit("/r")).alias("a"), C.repo_relative(F.lit("/x/b"), F.lit("/r")).alias("b")).first() == ("a/b", None)
