"""Exact top-k inner products with norm buckets.

Queries and candidates meet in cells of a grid: a candidate belongs to one of `stripes` by row, a query to
one of `blocks`, and both are sent to the cells of their line, so a cell holds a bounded number of either
and every pair meets exactly once.  Inside a cell the candidates are sorted by length (Euclidean norm) and
cut into buckets whose lengths differ by a factor of `ratio` at most.  Buckets are visited from the longest
down; each query keeps its k-th best product so far, t.  For a bucket with longest vector b, the local
cosine threshold is t / (|q| * |b|):

* above 1, nothing in this bucket or any later one can enter (length pruning of whole buckets);
* up to `turn`, only the prefix of the bucket with |v| >= t / |q| is verified (length pruning);
* above `turn`, coordinate pruning: a vector with such a cosine must have each of the query's `focus`
  largest coordinates within x*c -/+ sqrt((1 - x^2)(1 - c^2)), x being the unit query's coordinate.

What is left is verified by its integer product.  Products are exact: doubles where every sum stays below
2^53, Python integers beyond.  The k best of each cell are merged per query by (score, smaller id).

Defined cases: vectors that are null or hold null, NaN or infinite components, and rows with null id, take
no part; vectors of different dimension are not compared; a query is never paired with rows of its own id;
an exact repeat of a query row is one query, repeated candidates count each; scores beyond 64 bits are
written as the nearest 64-bit number.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESULT = "query_id bigint, query_key bigint, vec_id bigint, score bigint"


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def quantise(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; numbers from 2^53 on are whole already."""

    def one(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, one)


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All products of rows of q and v."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if bound < 2.0**53:
        return (q @ v.T).astype(np.int64)
    a, b = ([[int(x) for x in row] for row in m] for m in (q, v))
    lo, hi = 1 - 2**63, 2**63 - 1
    return np.array([[min(hi, max(lo, sum(x * y for x, y in zip(r, s)))) for s in b] for r in a], np.int64).reshape(len(a), len(b))


class Best:
    """The k best (score, smaller id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.filled = np.zeros(n, np.int64)

    def threshold(self) -> np.ndarray:
        return np.where(self.filled >= self.k, self.score[:, -1].astype(float), -np.inf)

    def add(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        if self.filled[row] >= self.k:
            near = scores >= self.score[row, -1]
            scores, ids = scores[near], ids[near]
        s = np.concatenate([self.score[row, : self.filled[row]], scores])
        i = np.concatenate([self.id[row, : self.filled[row]], ids])
        order = np.lexsort((i, -s))[: self.k]
        n = len(order)
        self.score[row, :n], self.id[row, :n], self.filled[row] = s[order], i[order], n


def search_cell(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, ratio: float = 0.9, turn: float = 0.75, focus: int = 3) -> Best:
    """Top k of each row of q among the rows of v with another id."""
    best = Best(len(q), k)
    qn, vn = np.sqrt((q * q).sum(1)), np.sqrt((v * v).sum(1))
    order = np.argsort(-vn, kind="stable")
    v, vid, vn = v[order], vid[order], vn[order]
    unit_q = q / np.where(qn > 0, qn, 1)[:, None]
    axes = np.argsort(-np.abs(unit_q), axis=1)[:, :focus]
    start, slack = 0, 1e-9
    while start < len(v):
        end = int(np.searchsorted(-vn, -ratio * vn[start], side="right")) if vn[start] > 0 else len(v)
        end = min(max(end, start + 1), start + 4096)
        own, ids, norms = v[start:end], vid[start:end], vn[start:end]
        t = best.threshold()
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(np.isinf(t), -np.inf, t / (qn * norms[0]))
        local = np.where((qn == 0) | (norms[0] == 0), np.where(t > 0, np.inf, -np.inf), local)
        dead, coord = local > 1 + slack, local > turn
        plain = np.flatnonzero(~dead & ~coord)
        for at in range(0, len(plain), 512):
            rows = plain[at : at + 512]
            # length pruning: no vector shorter than the least t / |q| of these queries
            need = np.where((t[rows] > 0) & (qn[rows] > 0), t[rows] / np.where(qn[rows] > 0, qn[rows], 1), 0).min()
            last = int(np.searchsorted(-norms, -need * (1 - slack), side="right"))
            if not last:
                continue
            scores = _exact(q[rows], own[:last])
            for r, s in zip(rows, scores):
                if best.filled[r] >= k:
                    near = np.flatnonzero(s >= best.score[r, -1])
                elif last > 4 * k:  # no tie with the k-th may be lost, nor the query's own id count
                    near = np.flatnonzero(s >= np.partition(s, last - k - 1)[last - k - 1])
                    if (ids[near] == qid[r]).sum() > 1:
                        near = np.arange(last)
                else:
                    near = np.arange(last)
                near = near[ids[near] != qid[r]]
                best.add(r, s[near], ids[near])
        unit = own / np.where(norms > 0, norms, 1)[:, None] if (coord & ~dead).any() else None
        for r in np.flatnonzero(coord & ~dead):
            c, alive = min(local[r], 1.0), np.ones(len(own), bool)
            for a in axes[r]:
                x = unit_q[r, a]
                width = math.sqrt(max(0.0, (1 - x * x) * (1 - c * c))) + 1e-7
                # A larger cosine only narrows the region towards x, so the ends are those at c or the crossing.
                high = 1.0 if x >= c else x * c + width
                low = -1.0 if -x >= c else x * c - width
                alive &= (unit[:, a] <= high) & (unit[:, a] >= low)
            near = np.flatnonzero(alive & (ids != qid[r]))
            if len(near):
                best.add(r, _exact(q[r : r + 1], own[near])[0], ids[near])
        if dead.all():
            break
        start = end
    return best


def top_products(vectors: DataFrame, is_query: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding", scale: int = 1024, stripe: int = 16384, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest products of each query row with the other rows."""
    rows = vectors.where(usable(F.col(vector)) & F.col(id).isNotNull()).select(F.col(id).cast("long").alias("vec_id"), quantise(F.col(vector), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n, nq = rows.agg(F.count("*"), F.count_if("q")).first()
    stripes, blocks = max(1, -(-n // stripe)), max(1, -(-nq // block))
    dim = F.size("v")
    # The row's number in its scan spreads repeats of one vector or id, too.
    line = lambda m, *of: F.pmod(F.xxhash64(*of), F.lit(m)).cast("int")
    candidates = rows.select("vec_id", "v", dim.alias("dim"), line(stripes, F.monotonically_increasing_id()).alias("stripe"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = (
        rows.where("q").select("vec_id", "v").distinct()
        .select("vec_id", "v", dim.alias("dim"), F.xxhash64("vec_id", "v").alias("key"), line(blocks, F.lit(7), "vec_id", "v").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))
    )

    def cell(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({x: np.array([], np.int64) for x in ("query_id", "query_key", "vec_id", "score")})
        matrix = lambda s: np.stack(s.to_list()).astype(np.float64).reshape(len(s), -1)
        qid, vid = q.vec_id.to_numpy(np.int64), c.vec_id.to_numpy(np.int64)
        best = search_cell(qid, matrix(q.v), vid, matrix(c.v), k)
        held = np.arange(best.k)[None, :] < best.filled[:, None]
        return pd.DataFrame({"query_id": np.repeat(qid, best.filled), "query_key": np.repeat(q.key.to_numpy(np.int64), best.filled), "vec_id": best.id[held], "score": best.score[held]})

    keys = ["dim", "block", "stripe"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(cell, RESULT)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
