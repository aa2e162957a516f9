"""Audit of sources: how far the words of each source of a language are from those of each other source and of the
language, in exact whole numbers.

Terms are runs of ASCII letters (A to Z lower-cased) and of all characters beyond ASCII.  A language keeps the terms that
enough of its documents hold.  Tasks count terms by (language, source); Spark adds the counts up, drops rare terms and
deals the kept ones out by range, so that chunks of a language's terms, and ids within a chunk, are in UTF-8 order.
Within a chunk the kept terms are a sorted array: searchsorted gives the ids, bincount the dense vector of each source,
and all smoothed shares, differences and ties are arithmetic on these vectors.  Sources are dealt into blocks, so that
a task holds one chunk of two blocks at most, however many terms and sources there are.

Defined cases: null text, language or source is the empty string; a group without terms takes part with counts of 0; a
language without kept terms has pairs of value 0 and no terms; a language of one source has no pairs; repeated rows count
as often as they occur; an empty table gives an empty result; other columns of the caller are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

#: ASCII letters in lower case and bytes beyond ASCII as they are; every other byte a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ONE, SMOOTH = 1_000_000_000, 2
COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def count_terms(batches: Iterator[pa.RecordBatch], most: int = 250_000) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> per group and term the occurrences and documents in this task, handed on when about
    `most` entries are held.  The empty term stands for the group itself."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for k in range(0, len(terms), 50_000):
                own = terms[k : k + 50_000]
                columns = [pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), pa.array(own, pa.binary()).cast(pa.string()), pa.array([n[t] for t in own], pa.int64()), pa.array([docs[t] for t in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        lang, source, text = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()
        for group, t in zip(zip(lang, source), text):
            n, docs = held.setdefault(group, (Counter({b"": 0}), Counter()))
            words = t.translate(TERM_BYTES).split() if t else ()
            n.update(words)
            docs.update(set(words))
        if sum(len(n) for n, _ in held.values()) > most:
            yield from flush()
    yield from flush()


def chunked(size: int):
    """Rows sorted by (lang, term) -> the same with `chunk`, a number for each `size` terms of a language, in the order
    of the terms, and `first`, 1 on one row of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, lang, term, k = TaskContext.get().partitionId() << 32, None, None, -1
        for batch in batches:
            chunk, first = [], []
            for own, t in zip(batch.column("lang").to_pylist(), batch.column("term").to_pylist()):
                if own != lang:
                    lang, term, k = own, None, -1
                new = t != term and t != ""
                k, term = k + new, t
                chunk.append(base + k // size if t else None)
                first.append(int(new))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk, pa.int64()), pa.array(first, pa.int64())], names=[*batch.schema.names, "chunk", "first"])

    return run


def share(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(ONE * n / whole), exact: in three steps of long division where the product would not fit in 64 bits.
    n is at most `whole`, which may reach 2^53."""
    if n.size == 0 or int(n.max()) < 2**63 // ONE:
        return 1 + ONE * n // whole
    out, rest = n // whole, n % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return 1 + out


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most ONE + 1, so the square fits in 64 bits."""
    return (p - q) ** 2 // (p + q)


def compare(best: int):
    """One cell, a chunk of terms of a language with two blocks of its sources -> its part of each pair's value, and in
    the cells of a block with itself the `best` terms of each source."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        lang, _, i, j = (x.as_py() for x in key)
        is_group = np.array(rows.column("term").is_null())
        groups, counts = rows.filter(pa.array(is_group)).sort_by("place"), rows.filter(pa.array(~is_group))
        place, whole = groups.column("place").to_numpy(), groups.column("whole").to_numpy()
        names, block = groups.column("source").to_pylist(), groups.column("block").to_numpy()
        terms = counts.column("term").to_numpy(zero_copy_only=False)
        kept, at = np.unique(terms, return_index=True)  # code points, and so UTF-8, in order
        cell = np.searchsorted(place, counts.column("place").to_numpy()) * len(kept) + np.searchsorted(kept, terms)
        n = np.bincount(cell, weights=counts.column("n").to_numpy(), minlength=len(place) * len(kept)).astype(np.int64).reshape(len(place), len(kept))
        p, none = share(n + SMOOTH, whole[:, None]), share(np.full(len(place), SMOOTH), whole)
        missing = groups.column("n_terms")[0].as_py() - len(kept)  # terms of the chunk that none of these sources has
        out: list[tuple] = []
        for a in np.flatnonzero(block == i):
            others = np.flatnonzero((block == j) & (np.arange(len(place)) != a))
            values = gap(p[a], p[others]).sum(axis=1) + missing * gap(none[a], none[others])
            for b, value in zip(others.tolist(), values.tolist()):
                out.append((names[a], "pair", names[b], value))
                if i != j:
                    out.append((names[b], "pair", names[a], value))
        if i == j and len(kept):
            q = share(counts.column("total").to_numpy()[at] + SMOOTH, groups.column("lang_whole").to_numpy()[:1])
            for a in range(len(place)):
                own = np.flatnonzero((n[a] > 0) & (p[a] > q))
                value = gap(p[a][own], q[own])
                for k in np.lexsort((own, -value))[:best].tolist():  # ids are in the order of the terms
                    out.append((names[a], "term", kept[own[k]], int(value[k])))
        source, part, item, value = zip(*out) if out else ((), (), (), ())
        return pa.table({"lang": pa.array([lang] * len(out), pa.string()), "source": pa.array(source, pa.string()), "part": pa.array(part, pa.string()), "item": pa.array(item, pa.string()), "value": pa.array(value, pa.int64())})

    return run


def audit(documents: DataFrame, least: int = 10, best: int = 10, chunk: int = 2048, wide: int = 64, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: the pairs of each source with the others of its language, and its terms.

    `least` documents keep a term, `best` terms are listed, a task holds `chunk` terms of two blocks of `wide` sources."""
    small_batches(documents.sparkSession)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = documents.select(said(lang).alias("lang"), said(source).alias("source"), F.col(text).cast("string").alias("text"))
    counted = read.mapInArrow(count_terms, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    totals = counted.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("total"), F.sum("docs").over(of_term).alias("docs"))
    kept = cut(totals.where((F.col("term") == "") | (F.col("docs") >= least)).drop("docs"))
    in_order = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    terms = cut(in_order.mapInArrow(chunked(chunk), "lang string, source string, term string, n bigint, total bigint, chunk bigint, first bigint"))
    real = terms.where(F.col("term") != "")

    of_lang = Window.partitionBy("lang")
    groups = (
        terms.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
        .select("lang", "source", F.col("n"), F.sum("first").over(of_lang).alias("v"), F.sum("n").over(of_lang).alias("lang_n"), (F.row_number().over(of_lang.orderBy("source")) - 1).alias("place"))
        .withColumns({"whole": F.col("n") + SMOOTH * F.col("v"), "lang_whole": F.col("lang_n") + SMOOTH * F.col("v"), "block": F.floor(F.col("place") / wide), "blocks": F.floor(F.max("place").over(of_lang) / wide) + 1})
    )
    groups = cut(groups.select("lang", "source", "place", "whole", "lang_whole", "block", "blocks"))
    chunks = real.groupBy("lang", "chunk").agg(F.sum("first").alias("n_terms"))
    chunks = groups.select("lang").distinct().join(chunks, "lang", "left").select("lang", F.coalesce("chunk", F.lit(-1)).alias("chunk"), F.coalesce("n_terms", F.lit(0)).alias("n_terms"))

    def cells(rows: DataFrame) -> DataFrame:
        """Each row once for every pair of blocks with its own."""
        other = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        return other.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")

    def nothing(kind: str) -> Column:
        return F.lit(None).cast(kind)

    as_groups = cells(groups.join(chunks, "lang")).withColumns({"term": nothing("string"), "n": nothing("bigint"), "total": nothing("bigint")})
    as_counts = cells(real.join(groups, ["lang", "source"])).withColumn("n_terms", nothing("bigint"))
    both = as_groups.unionByName(as_counts.select(*as_groups.columns))
    parts = both.groupBy("lang", "chunk", "i", "j").applyInArrow(compare(best), "lang string, source string, part string, item string, value bigint")
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= best))
