"""Tokenizer alignment, audit of sources and the language model, against brute force."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstone.llm.align import align
from quillstone.llm.divergence import audit, share
from quillstone.llm.lm import packed, score_texts, unpacked
from quillstone.llm.pitman_yor import discount, draw_tables, stirling_table
from quillstone.llm.q_divergence import SQL, op12_source_audit
from quillstone.llm.q_lm import op13_lm_score
from quillstone.llm.tokens import byte_letters

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", "  a  b ", "x▁y", "<s> </s> <|endoftext|> ok", "a\n \n b\t c", " ", "\x1c a", "ﬁ ① Å", "中文 没有 空格的文字很长", "it's I'LL 123 4", "  ", "\n", "a　b   c", "é́", "end ", "end ", "word " * 3000, "a" * 5000,
]


def aligned_by_hand(rows):
    """Whole texts through the tokenizers themselves, groups and links by the ends of tokens."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    letters, pieces = byte_letters(), {i: p for p, i in first.get_vocab().items()}
    a_bytes = lambda i: bytes(letters[c] for c in pieces[i])
    b_bytes = lambda i: bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()
    found, times = [], collections.Counter()
    for doc, text in rows:
        a, b = (first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)) if text else ([], [])
        said = (" " + (text or "")).encode()
        if b"".join(map(a_bytes, a)) != said or b"".join(map(b_bytes, b)) != said:
            found.append((doc, 0, 0, [], []))
            continue
        ends = []
        for ids, spell in ((a, a_bytes), (b, b_bytes)):
            n, own = 0, {}
            for k, i in enumerate(ids):
                n += len(spell(i))
                own[n] = k
            ends.append(own)
        groups, links, x, y = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            i, j = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            links.append((a[i - 1], b[j - 1]))
            x, y = i, j
        times.update(links)
        found.append((doc, len(a), len(b), groups, links))
    most = collections.Counter()
    for (_, b), n in times.items():
        most[b] = max(most[b], n)
    return sorted(
        (doc, n_a, n_b, len(groups), len(links), sum(times[x] == most[x[1]] for x in links), sum(times[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for doc, n_a, n_b, groups, links in found
    )


@pytest.mark.parametrize("characters", [16 << 20, 3000])
def test_alignment(spark, characters):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    rows = [(10_000 + k, t) for k, t in enumerate(ODD)] + [(10_000, "end "), (-1, None)]
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumns({"pair": F.lit(1), "block": F.lit("x")}).repartition(3)
    got = align(docs, A, B, characters=characters)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == aligned_by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_alignment_of_nothing(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    assert [tuple(r) for r in align(spark.createDataFrame([(None, None)], "doc_id long, text string"), A, B).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("chunk, wide", [(2048, 64), (5, 3)])
def test_audit_of_small_chunks_and_blocks(spark, chunk, wide):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet' WHERE doc_id < 400")
    got = audit(docs, chunk=chunk, wide=wide)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == sorted(con.sql(SQL["op12_source_audit"]).select("lang, source, part, item, value, rank").fetchall())


def test_audit_of_odd_tables(spark, tmp_path):
    common = "the cat É 漢字 don't"
    rows = [(k, common if k % 3 else "the The THE dog", "en" if k % 2 else None, f"s{k % 4}") for k in range(60)]
    rows += [(1, common, "en", "s1"), (2, None, "en", "empty"), (3, "", "xx", None), (4, "rare words", "xx", "a"), (5, "one", "alone", "only"), (None, "the cat", None, None)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit("x"), "chunk": F.lit(2)}).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    got = op12_source_audit(spark, str(tmp_path))
    columns = sorted(got.columns)
    want = con.sql(SQL["op12_source_audit"])
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.select(", ".join(columns)).fetchall())
    assert ("xx", "a", "pair", "", 0, 1) in [tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_of_large_counts_are_exact():
    rng = random.Random(5)
    whole = [rng.randrange(2**40, 2**53) for _ in range(200)]
    n = [rng.randrange(w) for w in whole]
    assert share(np.array(n), np.array(whole)).tolist() == [1 + 10**9 * a // w for a, w in zip(n, whole)]


def test_packed_arrays_come_back():
    arrays = [np.arange(1000), np.array([], np.int64), np.array([-5, 2**40]), np.array([0.25, -1e300]), np.array([True, False]), np.array([2**33, 1])]
    for x, y in zip(arrays, unpacked(packed(*arrays))):
        assert x.astype(float).tolist() == y.astype(float).tolist()


@pytest.mark.parametrize("d", [0.3, 0.8])
def test_drawn_tables_follow_their_weights(d):
    """Up to 64 customers exactly; beyond, mean and spread are near."""
    whole, rng = stirling_table(d, 300), np.random.default_rng(3)
    for c, others, p, above, grows, near in ((2, 3, 0.2, 1e3, False, 0.02), (7, 40, 0.1, 1e3, True, 0.02), (64, 10, 0.05, 1e3, True, 0.02), (300, 500, 0.05, 1e3, False, 0.05), (300, 50, 0.001, 1e3, False, 0.02), (300, 500, 0.05, 1e5, True, 0.05)):
        t, m = np.arange(1, c + 1), above * p
        w = whole[c, 1 : c + 1] + np.cumsum(np.log(1 + d * (others + np.arange(c))) + np.log((m + grows * np.arange(c)) / (above + grows * np.arange(c))))
        w = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
        got = draw_tables(np.full(20_000, c), np.full(20_000, float(others)), np.full(20_000, m), np.full(20_000, above), grows, d, 1.0, rng, stirling_table(d))
        assert abs(got.mean() / (w * t).sum() - 1) < near
        assert got.min() >= 1 and got.max() <= c
        if c <= 64:
            assert np.abs(np.bincount(got, minlength=c + 1)[1:] / 20_000 - w).max() < 0.015


def tokens(text):
    return [w.lower() for w in (text or "").encode().split()] + [b""]


def seated_one_by_one(train, texts, rounds, skip, strength=1.0, seed=1):
    """Mean probability of each word after each context, by Gibbs sampling of every customer's own table."""
    pairs = [(u, w) for t in train for own in [tokens(t)] for u, w in zip([b"", *own], own)]
    types, words = collections.Counter(pairs), {w for _, w in pairs}
    contexts = collections.Counter(w for _, w in types)
    ones = lambda c: discount(sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values()))
    d, d0, rng = ones(types), ones(contexts), random.Random(seed)
    rooms = collections.defaultdict(lambda: collections.defaultdict(list))  # context or None -> dish -> sizes of tables

    def p(u, w, own):
        room = rooms[u]
        n, t = sum(map(sum, room.values())), sum(map(len, room.values()))
        up = 1 / (len(words) + 1) if u is None else p(None, w, d0)
        return (sum(room[w]) - own * len(room[w]) + (strength + own * t) * up) / (strength + n)

    def enter(u, w, own):
        room = rooms[u]
        up = 1 / (len(words) + 1) if u is None else p(None, w, d0)
        weights = [n - own for n in room[w]] + [(strength + own * sum(map(len, room.values()))) * up]
        k = rng.choices(range(len(weights)), weights)[0]
        if k < len(room[w]):
            room[w][k] += 1
        else:
            room[w].append(1)
            if u is not None:
                enter(None, w, d0)

    def leave(u, w, own):
        sizes = rooms[u][w]
        k = rng.choices(range(len(sizes)), sizes)[0]
        sizes[k] -= 1
        if not sizes[k]:
            sizes.pop(k)
            if u is not None:
                leave(None, w, d0)

    for u, w in pairs:
        enter(u, w, d)
    asked = {(u, w) for t in texts for own in [tokens(t)] for u, w in zip([b"", *own], own)}
    sums = collections.Counter()
    for k in range(rounds):
        for u, w in pairs:
            leave(u, w, d)
            enter(u, w, d)
        if k >= skip:
            sums.update({x: p(*x, d) for x in asked})
    return [sum(math.log10(sums[x] / (rounds - skip)) for own in [tokens(t)] for x in zip([b"", *own], own)) for t in texts]


def test_language_model_of_a_small_corpus(spark):
    rng = random.Random(9)
    train = [" ".join(rng.choice(["a b c", "a b d", "c a", "d d a b", "e", "f g"]) for _ in range(4)) for _ in range(40)]
    texts = ["a b c", "", None, "A\tB  d d", "zzz unknown a", "g f g", "e"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(train)] + [(1000 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in score_texts(docs, F.col("doc_id") >= 1000, rounds=34, kept=30).collect()}
    want = seated_one_by_one(train, texts, 120, 20)
    for k, (t, s) in enumerate(zip(texts, want)):
        # Contexts are drawn side by side, given the parent of the round before; a parent of some 40 customers feels that.
        assert abs(got[1000 + k].score - s) < 0.05 + 0.05 * len(tokens(t)), (t, got[1000 + k].score, s)


def test_language_model_of_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op13_lm_score(spark, SF).collect()}
    assert len(got) == len(rows)
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    count = collections.Counter(w for d, t in rows if not held[d] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    for d, t in rows:
        own, r = tokens(t), got[d]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_of_odd_tables(spark):
    schema = "doc_id long, text string, kind int, held string"
    assert score_texts(spark.createDataFrame([], schema), F.lit(False)).count() == 0
    nothing = score_texts(spark.createDataFrame([(1, "a b", 1, ""), (None, None, 2, "")], schema), F.lit(True)).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in nothing) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]
    rows = [(k, "the hot context " * 50 + f"the w{k % 40}", 1, "x") for k in range(200)] + [(7, "the w3", 1, "x"), (None, "x", 0, None)]
    docs = spark.createDataFrame(rows, schema).repartition(5)
    scores = {}
    for buckets, size in (("1", 1 << 40), ("9", 18_000)):  # with nine or so, contexts are dealt over several
        scores[buckets] = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.base_score, r.score) for r in score_texts(docs, F.col("doc_id") % 5 == 0, block=4000, bucket=size).collect())
    assert len(scores["1"]) == len(rows)
    for x, y in zip(*scores.values()):
        assert x[:2] == y[:2] and math.isclose(x[2], y[2]) and abs(x[3] - y[3]) < 0.15 * x[1]  # other draws of tables
    assert abs(sum(x[3] - y[3] for x, y in zip(*scores.values()))) < 0.003 * sum(x[1] for x in scores["1"])


def test_long_private_keys_and_issued_keys_of_letters(spark):
    from quillstone.llm.secrets import mask_secrets

    body = "-".join("QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo" for _ in range(200))
    key = f"-----BEGIN PRIVATE KEY-----\n{body}\n-----END PRIVATE KEY-----"
    texts = [f"before\n{key}\nafter", "the token glpat-abcdefghijKLMNOPqrst is ours", "set ghp_abcdefghijklmnopqrstuvwxyzABCDEFGHIJ now"]
    docs = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in mask_secrets(docs).collect()}
    assert "QUJD" not in got[0] and got[0].startswith("before") and got[0].endswith("after")
    assert "abcdefghij" not in got[1] and got[1].startswith("the token ") and "abcdefghij" not in got[2]
