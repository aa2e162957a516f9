"""Language identification of whole texts, with spans for mixed ones.

A word is a run of ASCII letters and non-ASCII characters.  The script of its first letter, found by code
point range, narrows the languages to those whose training words use that script.  Its score in each of
them is the clipped log posterior of a naive Bayes model over character trigrams and the word itself,
hashed into a table of fixed size.  A Viterbi pass over the words, with a penalty for each change of
language, labels every word; runs of one label are the spans.

Each word's best rival of the language that is best in total is compared with it.  A path that leaves that
language does so in runs, each of which costs a switch at least and gains no more than its best rivals do; so
where no run of words gains more than the penalty that way, whatever the languages in it, the best path is
constant, which prefix sums show.  All other texts are walked, those of a batch together.

The model is trained from a sample of different labelled texts, at most about `per_language` of each language
(a documented bound), drawn by a hash of the text; everything else covers all rows and whole texts.

Defined cases: null text, and text without a letter, is `und` with score 0; ties go to the language that
sorts first; with no labelled row at all every text is `und`; repeated rows are predicted alike; an empty table
gives an empty result; extra columns, whatever their names, are kept by `keep_known` and ignored elsewhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches

UNKNOWN = "und"
BUCKETS = 1 << 16
CLIP = 6.0
TYPE = "struct<lang:string,score:double,spans:array<struct<start:int,end:int,lang:string>>>"
_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])

#: First and last code point of script blocks.
SCRIPTS = {
    "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x0530, 0x058F)],
    "hebrew": [(0x0590, 0x05FF)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x0900, 0x097F)],
    "bengali": [(0x0980, 0x09FF)],
    "tamil": [(0x0B80, 0x0BFF)],
    "thai": [(0x0E00, 0x0E7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2FA1F)],
}
SCRIPT_NAMES = ["latin", *SCRIPTS, "other"]
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def script_of(word: str) -> int:
    """Index in SCRIPT_NAMES of the script of the first letter; -1 if there is no letter."""
    for c in word:
        if c.isalpha():
            n = ord(c)
            if n < 0x250 or 0x1E00 <= n <= 0x1EFF:
                return 0
            return next((i for i, s in enumerate(SCRIPTS, 1) if any(a <= n <= b for a, b in SCRIPTS[s])), len(SCRIPT_NAMES) - 1)
    return -1


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the trigrams of all words in order, bucket of each word itself).  A word of n bytes has n
    trigrams, as it is bordered by < and >."""
    data = np.frombuffer(b"".join([b"<%b>" % w for w in words]), np.uint8).astype(np.uint32)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
    inside = np.ones(len(data), bool)
    inside[ends - 1] = inside[ends - 2] = False
    at = np.flatnonzero(inside)
    tri = ((data[at] << 16 | data[at + 1] << 8 | data[at + 2]) * np.uint32(2654435761)) >> np.uint32(16)
    return tri.astype(np.int64), np.fromiter((zlib.crc32(w) % BUCKETS for w in words), np.int64, len(words))


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, penalty: float = 8.0):
        """counts: languages x buckets; scripts: languages x scripts, in words."""
        self.langs, self.penalty = langs, penalty
        share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
        self.log = np.log(share).T.astype(np.float32).copy()
        used = scripts >= 0.01 * np.maximum(scripts.sum(1, keepdims=True), 1)
        used &= scripts > 0
        self.allowed = np.where(used.any(0), used, True).T  # scripts x languages

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(clipped log posterior of each word by language, whether the word has a letter)."""
        tri, whole = grams(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        s = np.add.reduceat(self.log[tri], ends - np.diff(ends, prepend=0), axis=0) + self.log[whole]
        scripts = np.fromiter((0 if w.isascii() else script_of(w.decode("utf-8", "ignore")) for w in words), np.int64, len(words))
        s = np.where(self.allowed[scripts], s, -1e9)
        s -= s.max(1, keepdims=True)
        return np.maximum(s - np.log(np.exp(s).sum(1, keepdims=True)), -CLIP), scripts >= 0

    def constant(self, scores: np.ndarray) -> int | None:
        """The language of the best path, where it is certain that this path keeps to one."""
        best = int(scores.sum(0).argmax())
        if scores.shape[1] > 1:
            rival = np.delete(scores, best, 1).max(1) - scores[:, best]
            gain = np.concatenate([[0.0], np.cumsum(rival)])
            if (gain - np.minimum.accumulate(gain)).max() > self.penalty:
                return None
        return best

    def paths(self, texts: list[np.ndarray], cells: int = 1 << 22) -> list[np.ndarray]:
        """The best language of each word of each text (ties: the first language, and no switch).

        `texts` are the scores of their words by language.  Up to about `cells` numbers are walked at once."""
        sure = [self.constant(s) for s in texts]
        out = [np.full(len(s), -1 if c is None else c, np.int64) for s, c in zip(texts, sure)]
        open_ = sorted((k for k, c in enumerate(sure) if c is None), key=lambda k: -len(texts[k]))
        while open_:
            some = open_[: max(1, cells // texts[open_[0]].size)]
            open_ = open_[len(some) :]
            for k, path in zip(some, self._walk([texts[k] for k in some])):
                out[k] = path
        return out

    def _walk(self, texts: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi over texts that are in order of length, the longest first."""
        lengths = np.array([len(s) for s in texts])
        n, m = int(lengths[0]), texts[0].shape[1]
        scores, came, own = np.zeros((n, len(texts), m)), np.zeros((n, len(texts), m), np.int16), np.arange(m)
        for k, s in enumerate(texts):
            scores[: len(s), k] = s
        v = scores[0].copy()
        alive = np.searchsorted(-lengths, -np.arange(n), side="left")  # texts with more than t words
        for t in range(1, n):
            now = v[: alive[t]]
            top = now.argmax(1)
            moved = now[np.arange(len(now)), top] - self.penalty
            switch = moved[:, None] > now
            came[t, : len(now)] = np.where(switch, top[:, None], own)
            v[: len(now)] = np.where(switch, moved[:, None], now) + scores[t, : len(now)]
        at, path = v.argmax(1), np.zeros((n, len(texts)), np.int64)
        for t in range(n - 1, -1, -1):
            path[t, : alive[t]] = at[: alive[t]]
            if t:
                at[: alive[t]] = came[t, np.arange(alive[t]), at[: alive[t]]]
        return [path[: len(s), k] for k, s in enumerate(texts)]


class Tagger:
    """Labels texts; remembers the scores of a bounded number of words."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.table = np.zeros((1024, len(self.model.langs)), np.float32)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Row of each word in the table; -1 for words without a letter.  New words are scored together."""
        if len(self.at) > self.most:
            self.clear()
        new = list(set(words).difference(self.at))
        if new:
            scores, real = self.model.word_scores(new)
            n = len(self.at)
            while n + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(new)] = scores
            self.at.update((w, k if r else -1) for k, (w, r) in enumerate(zip(new, real.tolist()), n))
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def tag_all(self, texts: list[bytes | None]) -> list[dict]:
        cut = [words_of(t) if t and self.model.langs else [] for t in texts]
        ids = self.ids([w for words in cut for w in words])
        ends = np.cumsum([len(w) for w in cut])
        own = [ids[e - len(w) : e] for w, e in zip(cut, ends)]
        real = [np.flatnonzero(i >= 0) for i in own]
        scores = [self.table[i[r]].astype(np.float64) for i, r in zip(own, real)]
        worded = [k for k, r in enumerate(real) if len(r)]
        out = [{"lang": UNKNOWN, "score": 0.0, "spans": []} for _ in texts]
        for k, path in zip(worded, self.model.paths([scores[k] for k in worded])):
            out[k] = self._tag(texts[k], real[k], scores[k], path)
        return out

    def _tag(self, text: bytes, real: np.ndarray, scores: np.ndarray, path: np.ndarray) -> dict:
        share = np.bincount(path, minlength=len(self.model.langs))
        lang = int(share.argmax())
        total = scores.sum(0)
        sure = 1 / np.exp(np.minimum(total - total[lang], 50)).sum()
        score = share[lang] / len(path) * (sure if share[lang] == len(path) else 1.0)
        runs = np.flatnonzero(np.diff(path, prepend=-1))
        return {"lang": self.model.langs[lang], "score": float(score), "spans": self._spans(text, real, path, runs)}

    def _spans(self, text: bytes, real: np.ndarray, path: np.ndarray, runs: np.ndarray) -> list[dict]:
        if len(runs) == 1:
            return [{"start": 0, "end": len(text.decode("utf-8", "replace")), "lang": self.model.langs[path[0]]}]
        inside = np.concatenate([[False], np.frombuffer(text.translate(_LETTERS), np.uint8) != 0x20])
        begin = np.flatnonzero(inside[1:] & ~inside[:-1])[real[runs]]
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        at = [0, *chars[begin[1:]].tolist(), int(chars[-1])]
        return [{"start": int(a), "end": int(b), "lang": self.model.langs[path[r]]} for a, b, r in zip(at, at[1:], runs)]


def train(labelled: DataFrame, per_language: int = 1500, text: str = "text", lang: str = "lang") -> Model:
    """A model from about `per_language` different texts of each language at most, chosen by their hash.

    Tasks make a table of fixed size for each language they meet; the tables of a language are added up in two
    steps, and the driver gets one of each language."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPT_NAMES))))
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, per_language / n))])
    drawn = rows.withColumn("key", F.xxhash64("text")).where(F.pmod("key", F.lit(1 << 30)) / float(1 << 30) < F.element_at(share, F.col("lang")))
    sample = drawn.dropDuplicates(["lang", "key"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                counts, scripts = tables.setdefault(own, (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)))
                words = words_of(value)
                of = [0 if w.isascii() else script_of(w.decode("utf-8", "ignore")) for w in words]
                words = [w for w, s in zip(words, of) if s >= 0]
                scripts += np.bincount([s for s in of if s >= 0], minlength=len(SCRIPT_NAMES))
                if words:
                    for found in grams(words):
                        counts += np.bincount(found, minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(tables), pa.string()), *[pa.array([zlib.compress(t[k].tobytes(), 1) for t in tables.values()], pa.binary()) for k in (0, 1)]], names=["lang", "counts", "scripts"]
        )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for own, *data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                tables = [np.frombuffer(zlib.decompress(d), np.int64) for d in data]
                total[own] = [a + b for a, b in zip(total[own], tables)] if own in total else tables
        packed = [pa.array([zlib.compress(t[k].tobytes(), 1) for t in total.values()], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *packed], names=["lang", "counts", "scripts"])

    schema = "lang string, counts binary, scripts binary"
    tables = sample.mapInArrow(count, schema)
    for salt in (F.pmod(F.xxhash64("counts"), F.lit(32)), F.lit(0)):
        tables = tables.repartition("lang", salt).mapInArrow(add_up, schema)
    langs = sorted(sizes)
    counts, scripts = np.zeros((len(langs), BUCKETS)), np.zeros((len(langs), len(SCRIPT_NAMES)))
    for r in tables.collect():  # one row a language
        counts[langs.index(r["lang"])] += np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64)
        scripts[langs.index(r["lang"])] += np.frombuffer(zlib.decompress(bytes(r["scripts"])), np.int64)
    return Model(langs, counts, scripts)


def tagger(documents: DataFrame, model: Model):
    """text column -> struct column: lang, score, spans (code points)."""
    small_batches(documents.sparkSession)
    said = documents.sparkSession.sparkContext.broadcast(vars(model))  # plain data; workers rebuild the model

    def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model.__new__(Model)
        vars(model).update(said.value)
        own = Tagger(model)
        for batch in batches:
            yield pa.array(own.tag_all(batch.cast(pa.binary()).to_pylist()), _ARROW)

    # Not marked deterministic: else a filter on the result is moved below it and all texts are tagged twice.
    udf = F.arrow_udf(tag, TYPE).asNondeterministic()
    return lambda column: udf(F.col(column) if isinstance(column, str) else column)


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo `folds`."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def identify(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score.  Rows of the fold 1 of 3 are held out of training."""
    held = F.coalesce(fold(doc_id, 3) == 1, F.lit(False))
    model = train(documents.where(~held), text=text, lang=lang)
    tagged = documents.select(F.col(doc_id).alias("doc_id"), held.alias("held_out"), tagger(documents, model)(text).alias("t"))
    return tagged.select("doc_id", "held_out", F.col("t.lang").alias("lang_pred"), F.col("t.score").alias("score"))


def keep_known(documents: DataFrame, least: float = 0.3, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Documents whose language is known and holds at least `least` of their words; `lang` becomes it."""
    model = train(documents.where(~F.coalesce(fold(doc_id, 3) == 1, F.lit(False))), text=text, lang=lang)
    name = free_name(documents, "__lang")
    tagged = documents.withColumn(name, tagger(documents, model)(text))
    kept = tagged.where((F.col(f"{name}.lang") != UNKNOWN) & (F.col(f"{name}.score") >= least))
    return kept.withColumn(lang, F.col(f"{name}.lang")).select(*documents.columns)
