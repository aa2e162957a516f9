"""What a step holds in memory and hands on must not grow with the product of its inputs."""

import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quillstone.functions.keeping import with_position
from quillstone.operators import chunking, hashed, lexicon, search
from quillstone.streaming import note_state


def vectors(spark, v, key):
    return spark.createDataFrame([(i, [float(x) for x in e]) for i, e in enumerate(v)], f"{key} long, embedding array<float>")


def test_the_coarse_phase_pairs_nothing_in_a_join(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 64)).astype(np.float32)
    v[50:120] = v[7]  # copies, so that ties reach beyond coarse_k
    q, c = vectors(spark, v[:90], "query_id"), vectors(spark, v, "chunk_id").repartition(5)
    found = search.coarse(q, c, 64, 30, F.col("query_id") == F.col("chunk_id"))
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Join" not in plan
    h = ((v[:90] > 0)[:, None, :] != (v > 0)[None, :, :]).sum(2)
    want = {(i, j, n, int(h[i, j])) for i in range(90) for n, j in enumerate(sorted((j for j in range(400) if j != i), key=lambda j: (h[i, j], j))[:30])}  # noqa: B023
    assert {(r.query_id, r.chunk_id, r.coarse, r.h) for r in found.collect()} == want
    few = search.coarse(q, c.limit(4), 64, 30)
    assert few.count() == 90 * 4 and search.coarse(q.limit(0), c, 64, 30).count() == 0 and search.coarse(q, c.limit(0), 64, 30).count() == 0


def test_a_wide_reach_compares_codes_without_a_join(spark):
    v = np.random.default_rng(2).normal(size=(300, 64)).astype(np.float32)
    v[9] = v[10] = v[11]
    found = hashed.within(vectors(spark, v[::3], "query_id").withColumn("query_id", F.col("query_id") * 3), vectors(spark, v, "chunk_id").repartition(4), 64, 19, hashed.pieces(64, 19, 4))
    assert "Join" not in found._jdf.queryExecution().toString()
    h = ((v[::3] > 0)[:, None, :] != (v > 0)[None, :, :]).sum(2)
    assert sorted(map(tuple, found.collect())) == sorted((int(i) * 3, int(j), int(h[i, j])) for i, j in zip(*np.nonzero(h <= 19)))


def test_nearest_vectors_of_large_cells_take_little_memory():
    rng = np.random.default_rng(3)
    q, v = rng.normal(size=(4096, 64)), rng.normal(size=(8192, 64))
    none = lambda x: np.full(len(x), None)
    tracemalloc.start()
    row, ids, d = search.closest((np.arange(4096), q, none(q)), (np.arange(8192), v, none(v)), 11)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and len(row) == 4096 * 11
    far = 1 - (q[5] @ v.T) / np.sqrt((q[5] ** 2).sum() * (v * v).sum(1))
    assert ids[row == 5].tolist() == np.argsort(far)[:11].tolist()


def test_a_lexical_search_shuffles_only_what_it_keeps(spark, tmp_path):
    words = "alpha beta gamma delta back off retry src 1".split()
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(rng.choice(words, 30)), f"d/{i % 3}/f{i}") for i in range(120)] + [(500, None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, relpath string").withColumn("symbol", F.col("relpath"))
    queries = spark.createDataFrame([(1, "back_off alph be"), (2, "src_1 src_1 gamma"), (3, "zzz"), (4, "")], "query_id long, query string")
    lexicon.write_segment(chunks, str(tmp_path))
    found = lexicon.search_index(queries, lexicon.read_segment(spark, str(tmp_path)), 7)
    assert "Join" not in found._jdf.queryExecution().toString()
    plain = lambda df: sorted((r.query_id, r.chunk_id, round(r.score, 5), r["rank"]) for r in df.collect())
    assert plain(found) == plain(search.lexical(queries, chunks, 7)) and {r[0] for r in plain(found)} == {1, 2}


def test_queries_of_the_same_words_are_expanded_once(spark):
    symbols = spark.createDataFrame([(f"Item > {a} part{i}",) for i in range(40) for a in ("red", "blue")], "symbol string")
    queries = spark.createDataFrame([(i, "blue part7" if i % 2 else "red  part7") for i in range(50)] + [(90, "nothing"), (91, None)], "query_id long, query string")
    found = search.expand_symbols(queries, symbols)
    windows = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number" in x]
    assert windows and not any("query_id" in x for x in windows)
    got = {r.query_id: r.expansions for r in found.collect()}
    assert got.keys() == set(range(50)) and got[1] == got[49] != got[0] == got[48] and all(len(x) == 8 for x in got.values())


def test_chunks_are_handed_on_in_small_parts(spark, monkeypatch):
    rows = [("r", f"f{i}.md", "\n".join(f"line {i} {j}" for j in range(i * 7))) for i in range(30)] + [("r", "none.md", None), (None, "x.py", "def f():\n    return 1\n")]
    files = spark.createDataFrame(rows, "repo_key string, relpath string, content string").coalesce(1)
    want = sorted(((k or "", p, s, c["start_line"], c["end_line"], c["symbol"] or "", c["content"]) for k, p, t in rows for s, c in enumerate(chunking.chunk_file(p, t))))
    for letters in (1, 300, 1 << 22):
        monkeypatch.setattr(chunking, "CUT_LETTERS", letters)
        found = chunking.chunk_files(files)
        assert sorted((r[0] or "", *r[1:5], r[5] or "", r[6]) for r in found.collect()) == want


class Value:
    """A state that counts what it is asked."""

    def __init__(self, calls):
        self.held, self.calls = None, calls

    def exists(self):
        self.calls.append("exists")
        return self.held is not None

    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, value):
        self.calls.append("update")
        self.held = value

    def clear(self):
        self.held = None


def test_events_of_a_note_cost_no_call_each():
    calls = []

    class Handle:
        def getValueState(self, *_):
            return Value(calls)

        def registerTimer(self, _):
            calls.append("timer")

    own = note_state.NoteState()
    own.init(Handle())
    rows = pd.DataFrame({"ms": range(0, 500_000, 1000), "seq": range(500), "kind": ["touch"] * 500})
    (out,) = own.handleInputRows((7,), iter([rows, rows]), None)
    assert out["access_count"].tolist() == [500] and len(calls) < 10
    own.handleExpiredTimer((7,), type("T", (), {"getCurrentWatermarkInMs": lambda _: 400_000})(), None)
    (out,) = own.handleInputRows((7,), iter([rows]), None)
    assert out["access_count"].tolist() == [500] and len(own._waiting()) == 100


def test_positions_are_kept_as_compressed_columns(spark):
    df = spark.createDataFrame([(i % 7, i, "text " * 50) for i in range(300)], "g int, i int, t string")
    found = with_position(df, [], ["g", "i"])
    assert "parquet" in found._jdf.queryExecution().toString() and "ExistingRDD" not in found._jdf.queryExecution().toString()
    assert [r.i for r in found.orderBy("position").collect()] == sorted(range(300), key=lambda i: (i % 7, i))
