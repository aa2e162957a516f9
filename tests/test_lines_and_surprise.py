"""Line numbers of a file read in many tasks, and the nearest earlier vector of a batch, against brute force."""

import numpy as np

from quillstone.operators import notes
from quillstone.sources.records import read_lines


def test_lines_of_a_file_in_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(2)
    texts = {f"s{i} +%.jsonl": "\n".join("é" * int(n) for n in rng.integers(0, 60, size)) + end for i, (size, end) in enumerate([(900, ""), (300, "\n"), (1, "\n\n"), (2, "\r\nx")])}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "none.jsonl").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = sorted(map(tuple, read_lines(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert got == sorted((name, i + 1, line) for name, text in texts.items() for i, line in enumerate(text.split("\n")) if line)


def test_the_nearest_earlier_vector(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(90, 8))
    v[40], v[41], v[50] = v[3], v[3], 0
    seq = rng.integers(0, 60, 90)  # ties are not earlier
    rows = [(100 + i, int(s), [float(x) for x in e]) for i, (s, e) in enumerate(zip(seq, v))]
    new = spark.createDataFrame(rows + [(999, 1, None)], "note_id long, seq long, embedding array<double>")
    u = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    d = 1 - u @ u.T
    want = {100 + i: min(d[i, j] for j in range(90) if seq[j] < seq[i]) for i in range(90) if (seq < seq[i]).any()}
    for block in (7, 4096):
        got = {r.note_id: r.d for r in notes.nearest_earlier(new, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert notes.nearest_earlier(new.limit(0)).count() == 0
    empty = spark.createDataFrame([], "note_id long, embedding array<double>")
    plan = notes.surprises(new, empty)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and {r.note_id: r.surprise for r in notes.surprises(new, empty).collect()}[999] == 1.0
