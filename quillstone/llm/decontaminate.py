"""Benchmark decontamination with one Aho-Corasick automaton over words.

Texts are normalised at byte level: A-Z to lower case, ASCII letters, digits and every non-ASCII byte
kept, all else a separator.  That keeps byte offsets, so word spans map straight back to the original
text.  Each run of `window` consecutive words of a benchmark item is a key of the automaton (an item of
fewer words is one key); its letters are ids of the benchmark's own words, every other word being 0.  One
scan of a document finds all windows that occur.

The items are broadcast; their size is measured first.  Beyond `shard_bytes` the items are dealt into
shards, one automaton and one scan each, and the hit words of a document are united across shards.

Defined cases: null or empty text has no words and is never contaminated; an item with null id or no words
takes no part; items that repeat an id count once; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))
TYPE = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,end:int>>>"
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


class Scanner:
    """The automaton of some items, and the scan of a text with it."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.ids: dict[bytes, int] = {}
        self.keys: list[tuple[int, list[str]]] = []
        at: dict[tuple[int, ...], int] = {}
        for item, text in items:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                key = tuple(ids[i : i + window])
                if key not in at:
                    at[key] = len(self.keys)
                    self.keys.append((len(key), []))
                if item not in self.keys[at[key]][1]:
                    self.keys[at[key]][1].append(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, k in at.items():
            self.automaton.add_word(key, k)
        if at:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word intervals [start, end) that windows cover, and the items they are of."""
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.keys or not words:
            return found, items
        for end, k in self.automaton.iter(tuple(map(self.ids.get, words, repeat(0)))):
            n, own = self.keys[k]
            items.update(own)
            start = end + 1 - n
            while found and found[-1][0] >= start:
                found.pop()
            if found and found[-1][1] >= start:
                found[-1] = (found[-1][0], end + 1)
            else:
                found.append((start, end + 1))
        return found, items


def spans_of(text: bytes, intervals: list[tuple[int, int]]) -> list[dict]:
    """Code-point spans in the original text of intervals of words."""
    if not intervals:
        return []
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], np.frombuffer(text.translate(NORMAL), np.uint8) != 0x20, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [{"start": int(chars[edge[2 * a]]), "end": int(chars[edge[2 * b - 1]])} for a, b in intervals]


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def contamination(benchmark: DataFrame, window: int = 13, shard_bytes: int = 64 << 20, item: str = "item_id", text: str = "text"):
    """text column -> struct column: n_words, n_hit, items (sorted as strings), spans of the hits."""
    spark = benchmark.sparkSession
    small_batches(spark)
    own = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).where("t is not null")
    total = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    # A shard holds shard_bytes of items on average; only one of them is in memory at a time.
    shards = [spark.sparkContext.broadcast([(r.i, bytes(r.t)) for r in own.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k).collect()]) for k in range(n)]

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only = Scanner(shards[0].value, window) if n == 1 else None
        for batch in batches:
            texts = batch.cast(pa.binary()).to_pylist()
            words = [words_of(t) for t in texts]
            found: list = [([], set()) for _ in texts]
            for shard in shards:
                scanner = only or Scanner(shard.value, window)
                for k, w in enumerate(words):
                    spans, items = scanner.scan(w)
                    if spans:
                        found[k] = (merged(found[k][0], spans), found[k][1] | items)
            yield pa.array(
                [{"n_words": len(w), "n_hit": sum(e - s for s, e in spans), "items": sorted(items), "spans": spans_of(t, spans)} for t, w, (spans, items) in zip(texts, words, found)],
                _ARROW,
            )

    udf = F.arrow_udf(scan, TYPE)
    return lambda column: udf(F.col(column) if isinstance(column, str) else column)


def is_contaminated(n_hit: Column, n_words: Column, share: int = 20) -> Column:
    """At least one word in `share` is hit."""
    return (n_hit > 0) & (F.lit(share) * n_hit >= n_words)


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with the columns they had."""
    hits = contamination(benchmark)
    name = free_name(documents, "__hits")
    kept = documents.withColumn(name, hits(text))
    return kept.where(~is_contaminated(F.col(f"{name}.n_hit"), F.col(f"{name}.n_words"))).drop(name)
