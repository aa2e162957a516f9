"""Texts of the store lie in segments: a commit deals them out once, writes them once and rewrites none."""

import os
import random

import pytest

from quillstone.functions.keeping import shared_folder
from quillstone.operators import ingest as I
from quillstone.operators.store import Store

FILES = "repo_key string, relpath string, content string, mtime_ms long"
PATHS = "repo_key string, relpath string"


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def text(seed, lines=150):
    rng = random.Random(seed)
    return "\n".join(" ".join(f"{rng.getrandbits(32):08x}" for _ in range(12)) for _ in range(lines))


def rows(spark, files):
    return spark.createDataFrame([("r", p, c, 1) for p, c in files.items()], FILES).repartition(3)


class Noting:
    """Writes down what it is asked."""

    dim = 2

    def __init__(self, folder):
        self.folder = folder

    def embed(self, texts):
        import json
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump(texts, f)
        return [[float(len(t)), 1.0] for t in texts]

    def asked(self):
        import json

        return [t for name in os.listdir(self.folder) for t in json.load(open(f"{self.folder}/{name}"))]


def test_texts_are_written_once(spark, tmp_path):
    store, embedder, none = Store(spark, str(tmp_path / "s"), 1), I.HashEmbedder(4), spark.createDataFrame([], PATHS)
    files = {f"d/f{k:02}.txt": text(k) for k in range(40)}
    letters, kept = sum(map(len, files.values())), size(shared_folder(spark))
    first = store.commit(rows(spark, files), none, embedder, 1, 0)
    written = size(tmp_path / "s") + size(shared_folder(spark)) - kept
    assert written < 2.5 * letters  # chunks overlap by a third, and the index has their words
    before, kept = size(tmp_path / "s"), size(shared_folder(spark))
    second = store.commit(rows(spark, {"d/f07.txt": text(99)}), spark.createDataFrame([("r", "d/f08.txt")], PATHS), embedder, 2, 1)
    written = size(tmp_path / "s") + size(shared_folder(spark)) - kept - before
    assert written < letters / 5
    assert store.table("chunks").select("relpath").distinct().count() == 39 and store.table("chunks", first).count() == first.last_chunk == 200
    assert second.last_chunk == 205 and store.table("chunks").where("relpath = 'd/f07.txt'").agg({"chunk_id": "min"}).first()[0] == 201


@pytest.mark.parametrize("merged", [False, True])
def test_segments_equal_a_full_rebuild(spark, tmp_path, merged):
    store, embedder, none = Store(spark, str(tmp_path / "s"), 3), I.HashEmbedder(4), spark.createDataFrame([], PATHS)
    files = {f"d/f{k:02}.txt": text(k, 30 * (k % 5)) for k in range(20)} | {"e/zero.txt": "a\0b", "e/none.txt": None}
    store.commit(rows(spark, files), none, embedder, 1, 0)
    ids = store.table("chunks").orderBy("chunk_id").collect()
    assert [r.chunk_id for r in ids] == list(range(1, len(ids) + 1)) and ids == sorted(ids, key=lambda r: (r.relpath, r.seq))
    changed = {"d/f03.txt": files["d/f03.txt"] + "\nmore", "d/f04.txt": "", "f/new.txt": text(50)}
    store.commit(rows(spark, changed), spark.createDataFrame([("r", "d/f01.txt")], PATHS), embedder, 2, 1)
    if merged:
        before = sorted(map(tuple, store.table("chunks").collect()))
        last = store.merge()
        assert [t for t, _ in last.at].count("texts") == 1 and before == sorted(map(tuple, store.table("chunks").collect()))
    again = {"d/f01.txt": files["d/f01.txt"]}
    store.commit(rows(spark, again), none, embedder, 3, 2)
    rebuilt, _ = I.sync(I.empty_snapshot(spark), rows(spark, files | changed | again), none, embedder)
    part = ["repo_key", "relpath", "seq", "start_line", "end_line", "symbol", "content", "content_hash", "embedding", "mtime_ms"]
    plain = lambda df: sorted(map(str, df.select(*part).collect()))
    assert plain(store.searchable()) == plain(rebuilt.chunks)
    assert sorted(map(str, store.table("files").collect())) == sorted(map(str, rebuilt.files.select(*store.table("files").columns).collect()))


def test_each_new_input_is_embedded_once(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    store, embedder, none = Store(spark, str(tmp_path / "s"), 4), Noting(str(tmp_path / "asked")), spark.createDataFrame([], PATHS)
    same, most = "same\n" * 400, text(1, 400) + "\n" + "same\n" * 120
    for k, files in enumerate([{"a.txt": same}, {"b.txt": most}, {"b.txt": most + "tail", "c.txt": text(2)}, {"a.txt": same}]):
        store.commit(rows(spark, files), none, embedder, k, k)
        asked = embedder.asked()
        assert len(asked) == len(set(asked)) == store.table("vectors").count()
        assert store.searchable().count() == store.table("chunks").count()
