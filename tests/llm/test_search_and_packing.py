"""Top-k, packing, near duplicates, language, toxicity and the pipeline against plain versions."""

import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillstone.llm import langid, ngram_join, toxicity
from quillstone.llm.components import components
from quillstone.llm.decontaminate import contamination, is_contaminated
from quillstone.llm.packing import Encoder, pack, plan
from quillstone.llm.shingles import Hasher, text_buffers
from quillstone.llm.topk import search_cell, top_products

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def best(rows, k):
    out = set()
    for q, v in rows:
        if q is None or q % 3 or v is None or not all(x is not None and math.isfinite(x) for x in v):
            continue
        own = [math.floor(1024 * x) for x in v]
        scored = sorted((-sum(a * math.floor(1024 * b) for a, b in zip(own, w)), i) for i, w in rows if i is not None and i != q and w is not None and len(w) == len(v) and all(x is not None and math.isfinite(x) for x in w))
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("stripe,block", [(16384, 4096), (7, 5)])
def test_top_products_equal_brute_force(spark, stripe, block):
    rng = random.Random(stripe)
    rows = [(i, [round(rng.gauss(0, 1) * rng.choice([0.01, 1, 4]), 2) for _ in range(4)]) for i in range(60)]
    rows += [(60, [0.0] * 4), (61, rows[3][1]), (62, None), (63, [1.0, None, 0.0, 2.0]), (66, [float("nan")] * 4), (None, [1.0] * 4), (69, [float("inf"), 0.0, 0.0, 0.0]), (72, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in top_products(df, F.col("vec_id") % 3 == 0, k=5, stripe=stripe, block=block).collect()}
    assert got == best(rows, 5)


def test_top_products_of_very_long_components(spark):
    rows = [(0, [1e15, 0.5]), (3, [0.0021, 1e-3]), (4, [0.0031, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    got = [(r.query_id, r.rank, r.vec_id) for r in top_products(df, F.col("vec_id") % 3 == 0, k=5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 4), (0, 2, 3), (3, 1, 0), (3, 2, 4)]
    assert top_products(df.limit(0), F.lit(True)).count() == 0


def test_pruning_loses_nothing():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(5, 16))
    v = np.floor(1024 * (centre[rng.integers(0, 5, 6000)] + 0.05 * rng.normal(size=(6000, 16))) * rng.exponential(1, (6000, 1)))
    q, ids = v[:50], np.arange(6000)
    got = search_cell(ids[:50], q, ids, v, 10)
    scores = (q @ v.T).astype(np.int64)
    scores[np.arange(50), np.arange(50)] = np.iinfo(np.int64).min
    for r in range(50):
        order = sorted(ids.tolist(), key=lambda i: (-int(scores[r, i]), i))[:10]
        assert got.id[r].tolist() == order


def test_plans_hold_all_and_waste_little():
    rng = random.Random(0)
    for _ in range(200):
        capacity = rng.choice([10, 30, 64])
        counts = {rng.randint(1, capacity): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
        packed, held = plan(dict(counts), capacity), {}
        for lengths, n in packed:
            assert sum(lengths) <= capacity and n > 0
            for x in lengths:
                held[x] = held.get(x, 0) + n
        assert held == counts
        least = max(-(-sum(k * n for k, n in counts.items()) // capacity), sum(n for k, n in counts.items() if 2 * k > capacity))
        assert least <= sum(n for _, n in packed) <= 1.5 * least + 1


def test_packing_places_every_piece_once(spark):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", F.lit(1).alias("piece"))
    docs = docs.union(spark.createDataFrame([(10**6, None, 1), (10**6 + 1, "", 1), (10**6 + 2, "x<|endoftext|>y  \n ", 1), (10**6 + 2, "again", 1)], docs.schema)).repartition(5)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2])
    rows = pack(docs, TOKENIZER).collect()
    expected = set()
    for i, own in texts.items():
        for ids in own:
            first = len(ids) % 1024 or 1024
            for k, s in enumerate([0, *range(first, len(ids), 1024)]):
                part = ids[s : s + (first if k == 0 else 1024)]
                expected.add((i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert len(rows) == len(expected) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= 1.06 * -(-sum(r.length for r in rows) // 1024)
    assert pack(docs.limit(0), TOKENIZER).count() == 0


def test_sequences_are_few_at_a_larger_size(spark):
    rows = pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), TOKENIZER).agg(F.sum("length").alias("n"), F.count_distinct("sequence_id").alias("s")).first()
    assert rows.s <= 1.01 * -(-rows.n // 1024), (rows.s, rows.n / 1024)


def test_texts_of_one_long_run(spark):
    encoder = Encoder(open(TOKENIZER, encoding="utf-8").read())
    texts = ["x" + " " * 3_000_000 + "y", "a" * 1_000_000, "\n" * 1_000_000 + "z"]
    for text in texts:
        assert encoder(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    rows = pack(spark.createDataFrame([(1, texts[0], "x"), (2, None, "x"), (2, None, "x")], "doc_id long, text string, sequence_id string"), TOKENIZER).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == len(encoder(texts[0])) + 1 and len([r for r in rows if r.doc_id == 2]) == 2


def test_ranked_encoder_equals_the_tokenizer():
    encoder = Encoder(open(TOKENIZER, encoding="utf-8").read())
    assert encoder.ranked is not None
    for text in ["", "  a  b\n\n\tc  ", "x\x1cy z  q　w", "don't  'll\r\n x<|endoftext|>y  ", "​a \x85b", "   ", "é́ ü ß 漢字 test🙂🙂 ok"]:
        assert encoder(text).tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def shingles(text, size=3):
    w = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def linked(docs, size=3, percent=90):
    """Components by all pairs."""
    sets = {i: shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if c and 100 * c >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([5, 40, 120, 400, 1200]))] for _ in range(6)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 50))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            w = w + passage
        docs.append((i, rng.choice([" ", "\n", "  "]).join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    return docs


@pytest.mark.parametrize("seed,window,block,split,size,percent,many", [(1, 64, 4096, 32, 3, 90, 2), (3, 2, 3, 4, 3, 90, 1000), (4, 1, 2, 2, 5, 80, 0), (5, 64, 4096, 32, 5, 80, 0)])
def test_near_duplicates_equal_all_pairs(spark, monkeypatch, seed, window, block, split, size, percent, many):
    monkeypatch.setattr(ngram_join, "SPLIT", split)
    docs = near_copies(seed, 150) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "two one"), (1007, "q " * 30000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, component_id int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(df, percent, 100, size, window=window, block=block, many=many).collect()}
    assert got == linked(docs, size, percent)


def test_one_of_each_takes_five_words_and_four_fifths(spark):
    docs = near_copies(7, 60) + [(1000, None), (1001, ""), (1002, None)]
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in docs] + [(3, docs[3][1], 0, 1), (None, docs[3][1], 0, 1)], "doc_id long, text string, component_id int, __gone int")
    own = linked(docs, 5, 80)
    kept = [r.doc_id for r in ngram_join.one_of_each(df).collect()]
    assert sorted(kept, key=str) == sorted([*(i for i in own if own[i][1] == i), *([3] if own[3][1] == 3 else []), None], key=str)


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (3, "A b  c d"), (None, "a b c d"), (9, "x y z")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(5, 2, 3), (5, 2, 3), (3, 2, 3), (None, 2, None), (9, 1, 9)], key=str)
    assert ngram_join.similar_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_word_longer_than_a_hashed_piece():
    import pyarrow as pa

    hasher = Hasher(3)
    alone = hasher.sets(*text_buffers(pa.array(["x" * 600_000 + " y z"])))[0]
    beside = hasher.sets(*text_buffers(pa.array(["q", None, "x" * 600_000 + " y z"])))
    assert (alone == beside[2]).all() and len(beside[1]) == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 30)] + [(200, 201), (201, 200), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{k: 1 for k in range(2, 30)}, 201: 200}


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet".replace("sf0.001", "sf0.01"))
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_cases(spark):
    rows = [(i, "the cat and the dog of the house and the tree " * 3, "en") for i in range(9)] + [(20 + i, "der hund und die katze auf dem haus unter " * 3, "de") for i in range(9)]
    rows += [(40 + i, "собака и кошка в доме на дереве", "ru") for i in range(9)] + [(90, None, "en"), (91, "12 !!", None), (92, "", "de"), (93, "собака the", None), (94, "the cat and the dog of the house der hund und die katze auf dem haus und die", None)]
    docs = spark.createDataFrame([(i, t, g, "x") for i, t, g in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert [got[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3 and got[91].score == 0
    assert got[93].lang_pred in ("en", "ru") and got[0].lang_pred == "en" and got[20].lang_pred == "de" and got[41].lang_pred == "ru"
    tags = docs.where("doc_id = 94").select(langid.tagger(docs, langid.train(docs))("text").alias("t")).first().t
    assert [s.lang for s in tags.spans] == ["en", "de"] and tags.spans[1].start == rows[-1][1].index("der hund")
    assert langid.keep_known(docs).where("doc_id in (90, 91, 92)").count() == 0
    assert langid.identify(docs.limit(0)).count() == 0 and langid.keep_known(docs.withColumn("__lang", F.lit(1)).limit(0)).columns[-1] == "__lang"
    twice = docs.where("doc_id = 0").union(docs.where("doc_id = 0"))
    assert len({(r.lang_pred, r.score) for r in langid.identify(docs.union(twice)).where("doc_id = 0").collect()}) == 1
    none = langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert (none.lang_pred, none.score) == ("und", 0.0)


def value(scores, path, penalty):
    return sum(scores[t, p] for t, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_paths_are_the_best(m):
    rng = np.random.default_rng(m)
    model = langid.Model([str(k) for k in range(m)], np.ones((m, langid.BUCKETS)), np.ones((m, len(langid.SCRIPT_NAMES))), penalty=2.0)
    texts = [rng.normal(size=(rng.integers(1, 6), m)) * rng.choice([0.5, 1, 2]) for _ in range(60)]
    for cells in (1, 1 << 22):
        for scores, path in zip(texts, model.paths(texts, cells)):
            n = len(scores)
            assert value(scores, path.tolist(), 2.0) == pytest.approx(max(value(scores, [k // m**t % m for t in range(n)], 2.0) for k in range(m**n)))


def test_a_path_through_two_rivals_is_found():
    model = langid.Model(["a", "b", "c"], np.ones((3, langid.BUCKETS)), np.ones((3, len(langid.SCRIPT_NAMES))))
    scores = np.array([[0, -6, -2.3]] * 3 + [[-6, 0, -2.3]] * 3, float)
    assert model.paths([scores])[0].tolist() == [0, 0, 0, 1, 1, 1]


def plain_tag(model, text):
    """Language and spans of a text, word by word."""
    words = [(w, model.word_scores([w])) for w in langid.words_of((text or "").encode())]
    scores = [s[0] for _, (s, real) in words if real[0]]
    if not scores:
        return "und", []
    best = [(float(x), [k]) for k, x in enumerate(scores[0])]
    for row in scores[1:]:
        best = [max(((v - (model.penalty if path[-1] != k else 0) + float(x), [*path, k]) for v, path in best), key=lambda p: p[0]) for k, x in enumerate(row)]
    path = max(best, key=lambda p: p[0])[1]
    runs = [k for i, k in enumerate(path) if i == 0 or path[i - 1] != k]
    return model.langs[max(range(len(model.langs)), key=path.count)], [model.langs[k] for k in runs]


def test_languages_equal_a_walk_word_by_word(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    rng = random.Random(4)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    mixed = [" ".join(" ".join(rng.choice(texts).split()[: rng.randint(3, 30)]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *mixed, None, "", "12"])], "i int, text string").select("i", "text", langid.tagger(docs, model)("text").alias("t")).collect()
    for r in got:
        lang, spans = plain_tag(model, r.text)
        assert (r.t.lang, [s.lang for s in r.t.spans]) == (lang, spans)
        assert not spans or (r.t.spans[0].start, r.t.spans[-1].end) == (0, len(r.text))


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    hit = [r.predicted for r in rows if r.toxic == 1]
    false = [r.predicted for r in rows if r.toxic == 0]
    assert sum(hit) > 0.7 * len(hit) and sum(false) < 0.03 * len(false)


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "y"), (3, "y")], "doc_id long, text string")
    assert toxicity.score_toxicity(docs.withColumn("score", F.lit("x")).limit(0), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).count() == 0
    rows = toxicity.score_toxicity(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == 5 and all(r.score == 0 and r.predicted == 0 for r in rows)
    rows = toxicity.score_toxicity(docs, spark.createDataFrame([(1, 1, 1), (3, 1, 1), (3, 1, 0), (None, 1, 1), (2, 0, None)], "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)


def toxic_table(spark, copies, rows=1000):
    """Documents of common words, toxic ones among them, one of which has `copies` copies; every second one is labelled."""
    rng = random.Random(5)
    plain = [f"plain{k}" for k in range(60)]
    marks = [f"venom{chr(97 + k)}" for k in range(6)]
    made = []
    for _ in range(rows - copies):
        toxic = rng.random() < 0.128
        made.append((rng.sample(plain, 12) + (rng.sample(marks, 3) if toxic else []), int(toxic)))
    made += [([*plain[:12], *marks[:4]], 1)] * copies
    rng.shuffle(made)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, (w, _) in enumerate(made)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 1, t) for i, (_, t) in enumerate(made) if i % 2], "doc_id long, quality int, toxic int"), [t for _, t in made]


@pytest.mark.parametrize("copies", [0, 450, 700])
def test_toxicity_whatever_the_number_of_toxic_copies(spark, copies):
    docs, labels, toxic = toxic_table(spark, copies)
    rows = [r for r in toxicity.score_toxicity(docs, labels).collect() if r.held_out]
    hit, false = ([r.predicted for r in rows if toxic[r.doc_id] == t] for t in (1, 0))
    assert sum(hit) > 0.9 * len(hit) and sum(false) < 0.05 * len(false)


def test_toxicity_of_three_positives(spark):
    docs, _, toxic = toxic_table(spark, 0)
    train = docs.where(~toxicity.held_out())
    few = [r.doc_id for r in train.orderBy("doc_id").collect() if toxic[r.doc_id]][:3]
    model = toxicity.train(train, spark.createDataFrame([(i,) for i in few], "doc_id long"), 0.1)
    assert model.weights


def test_training_corrects_for_the_prior():
    rng = np.random.default_rng(0)
    toxic = lambda n: np.hstack([rng.random((n, 3)) < 0.7, rng.random((n, 5)) < 0.3])
    clean = lambda n: np.hstack([np.zeros((n, 3), bool), rng.random((n, 5)) < 0.3])
    w = toxicity.train_nnpu(toxic(200), np.vstack([toxic(100), clean(900)]), 0.1)
    score = lambda x: x @ w[:-1] + w[-1]
    assert (score(clean(200)) < 0).mean() > 0.97 and (score(toxic(200)) > 0).mean() > 0.7


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "benchmark", "secrets", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10**6, None, "en", "s", 0), (10**6 + 1, "12 34", "en", "s", 5), (10**6 + 2, docs.where("doc_id = 1").first().text, "en", "s", 1)]
    docs.union(spark.createDataFrame(extra, docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id for r in langid.identify(docs).where("lang_pred <> 'und' and score >= 0.3").collect()}
    assert 10**6 not in known and 10**6 + 1 not in known
    alone = linked([(i, texts[i]) for i in known], 5, 80)
    kept = {i for i in known if alone[i][1] == i}
    hits = contamination(spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    bad = {r.doc_id for r in docs.select("doc_id", hits("text").alias("h")).where(is_contaminated(F.col("h.n_hit"), F.col("h.n_words"))).collect()}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == kept - bad
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, str(tmp_path))
        assert current.columns == docs.columns
