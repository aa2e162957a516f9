"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all documents, whatever their labels, is the
unlabelled set.
With the class prior p the risk of a scorer g is

    p * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - p * E_pos[loss(-g)])

and when the second part falls below zero the step goes up its gradient instead (the non-negative
correction).  The scorer is linear over the presence of words and word beginnings; numpy trains it on the
driver from a bounded sample.  Only beginnings and words that are over-represented among the positives,
against the rate that the prior leaves to the negatives, are features, so that a long clean text gathers no
weight from its many ordinary words.

Bounds: at most about `positives` and `unlabelled` sampled rows and `features` features.  Rows are drawn by a
hash of id and text, so the sample does not depend on how the table is laid out, and rows that repeat an id with
its text are drawn once.  Counts for the choice of features come from that sample.  All rows are scored, from their
whole texts.

Defined cases: null and empty texts have no feature and get the bias's score; with no positive at all
every score is 0; with positives that no word tells from the rest, every score is that of the bias -4 (0.018); a row
without id is never held out; labels of ids that repeat count as toxic if any does; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memo, cut, small_batches
from .langid import fold

BUCKETS = 1 << 20
_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "ignore").translate(_LETTERS).split() if text else []


def features_of(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings of 3 to 6 characters."""
    w = word.decode("utf-8", "ignore")
    return (zlib.crc32(b"=" + word) % BUCKETS, *(zlib.crc32(b"^" + w[:n].encode()) % BUCKETS for n in range(3, 7) if len(w) > n))


def train_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 100, rate: float = 0.05, decay: float = 1e-4, slack: float = 0.0, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a linear scorer, by Adam on the corrected risk with sigmoid loss.

    The correction starts when the negative part is below -slack * prior."""
    rng = np.random.default_rng(seed)
    p = np.hstack([positive, np.ones((len(positive), 1))]).astype(np.float32)
    u = np.hstack([unlabelled, np.ones((len(unlabelled), 1))]).astype(np.float32)
    w = np.zeros(p.shape[1])
    w[-1] = -1.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    step, parts = 0, max(1, len(u) // 1500)
    for _ in range(epochs):
        orders = np.array_split(rng.permutation(len(p)), parts), np.array_split(rng.permutation(len(u)), parts)
        for at_p, at_u in zip(*orders):
            if not len(at_p) or not len(at_u):
                continue
            x, y = p[at_p], u[at_u]
            sp, su = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1 / (1 + np.exp(-np.clip(y @ w, -30, 30)))
            rise_p, rise_u = x.T @ (sp * (1 - sp)) / len(x), y.T @ (su * (1 - su)) / len(y)
            negative = su.mean() - prior * sp.mean()
            grad = rise_u - 2 * prior * rise_p if negative >= -slack * prior else prior * rise_p - rise_u
            grad = grad + decay * np.append(w[:-1], 0)
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


class Model:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias


def _chance(salt: int, *of: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), *of), F.lit(1 << 30)) / float(1 << 30)


def _sample(documents: DataFrame, toxic_ids: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """Rows (text, p): documents of sampled toxic ids, and a sample of all documents, into which positives
    come as often as they occur.  The ids are sampled before they meet the texts, so that they are few
    enough to be sent to them and no text is shuffled but those of the sample."""
    ids = toxic_ids.where("__id is not null").distinct()
    picked = ids.where(_chance(1, "__id") < positives / max(1, ids.count()))
    marked = documents.join(F.broadcast(picked), "__id").select("__id", "text")
    marked = marked.where(_chance(2, "__id", "text") < positives / max(1, marked.count()))
    drawn = documents.where(_chance(3, "__id", "text") < unlabelled / max(1, documents.count())).select("__id", "text")
    own = marked.withColumn("p", F.lit(True)).union(drawn.withColumn("p", F.lit(False)))
    return own.withColumn("key", F.xxhash64("text")).dropDuplicates(["__id", "key", "p"]).select("text", "p")


def train(documents: DataFrame, toxic_ids: DataFrame, prior: float, positives: int = 2000, unlabelled: int = 6000, features: int = 1500, doc_id: str = "doc_id", text: str = "text") -> Model | None:
    """`toxic_ids` holds the ids of the confirmed toxic documents among `documents`."""
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).where("text is not null")
    sample = cut(_sample(rows, toxic_ids.select(F.col(doc_id).alias("__id")), positives, unlabelled).repartition(8))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = Memo(features_of), np.zeros((2, BUCKETS), np.int32)
        for batch in batches:
            for value, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set().union(*map(known.__getitem__, set(words_of(value))))
                n[int(p), np.fromiter(own, np.int64, len(own))] += 1
        at = np.flatnonzero(n[1])  # features of no positive are of no use
        for a in np.array_split(at, max(1, len(at) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(n[1, a], pa.int64()), pa.array(n[0, a], pa.int64())], names=["f", "np", "nu"])

    n_p, n_u = sample.agg(F.count_if("p"), F.count_if(~F.col("p"))).first()
    if not n_p or not n_u:
        return None
    counts = sample.mapInArrow(count, "f bigint, np bigint, nu bigint").groupBy("f").agg(F.sum("np").alias("np"), F.sum("nu").alias("nu"))
    # The unlabelled hold positives at the prior's share; what is left is the negatives' rate.
    negative = F.greatest((F.col("nu") / n_u - prior * F.col("np") / n_p) / (1 - prior), F.lit(0.5 / n_u))
    often = max(min(5, n_p), n_p // 150)
    chosen = [r["f"] for r in counts.where(F.col("np") >= often).where(F.col("np") / n_p >= 2.5 * negative).orderBy(F.desc("np"), "f").limit(features).select("f").collect()]
    if not chosen:
        return Model({}, -4.0)
    index = {f: i for i, f in enumerate(sorted(chosen))}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memo(lambda w: [index[f] for f in features_of(w) if f in index])
        for batch in batches:
            own = [sorted(set().union(*map(known.__getitem__, set(words_of(t))))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column(1)], names=["own", "p"])

    held: dict[bool, list] = {True: [], False: []}
    for r in sample.mapInArrow(found, "own array<int>, p boolean").collect():  # the bounded sample's features
        held[r["p"]].append(r["own"])
    dense = {}
    for p, own in held.items():
        own.sort()
        dense[p] = np.zeros((len(own), len(index)), np.float32)
        for i, f in enumerate(own):
            dense[p][i, f] = 1
    w = train_nnpu(dense[True], dense[False], prior)
    return Model({f: float(w[i]) for f, i in index.items()}, float(w[-1]))


def scorer(documents: DataFrame, model: Model | None):
    """text column -> score column."""
    small_batches(documents.sparkSession)
    said = documents.sparkSession.sparkContext.broadcast(model and (model.weights, model.bias))

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias = said.value
        known = Memo(lambda w: tuple(f for f in features_of(w) if f in weights))
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                marks = set(map(known.__getitem__, words_of(text)))
                g = bias + sum(weights[f] for f in sorted(set().union(*marks)))
                out.append(1 / (1 + float(np.exp(-min(max(g, -40), 40)))))
            yield pa.array(out, pa.float64())

    if model is None:
        return lambda column: F.lit(0.0)
    udf = F.arrow_udf(score, "double")
    return lambda column: udf(F.col(column) if isinstance(column, str) else column)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(False))


def score_toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted.  Labels of the held-out fold are never read for training."""
    seen = labels.where(~held_out() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    known, toxic = seen.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    model = train(documents.where(~held_out()), seen.where("toxic = 1"), prior=min(0.9, toxic / known)) if toxic else None
    scored = documents.select("doc_id", held_out().alias("held_out"), scorer(documents, model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
