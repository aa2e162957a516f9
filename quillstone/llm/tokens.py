"""Greedy word-piece lengths with a linear longest-match automaton.

The vocabulary is a trie of bytes with two roots: one for pieces that begin a word, one for pieces that
continue it.  Each node has a failure link (where matching goes on once the longest piece so far is cut
off) and the number of pieces that following the link pops; a second number says how many pieces are
popped when the word ends at the node.  Counting a word's pieces then takes time linear in its length and
builds no piece.

Defined cases: null or empty text has no words and no tokens; a word that the vocabulary cannot spell is
one unknown token; rows are neither joined nor grouped, so repeated rows stay as they are.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .common import Memo, small_batches

TYPE = "struct<n_words:bigint,n_tokens:bigint,n_unknown:bigint>"
_ARROW = pa.struct([("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])


class Automaton:
    WORD, REST = 0, 1  # the two roots

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]):
        self.next: dict[int, int] = {}
        self.fail: list[int] = [-1, -1]
        self.pops: list[int] = [0, 0]
        ends = {self._add(self.WORD, p) for p in initial if p} | {self._add(self.REST, p) for p in continuing if p}
        self._link(ends)
        self.tail = [self._tail(u) for u in range(len(self.fail))]

    def _add(self, u: int, piece: bytes) -> int:
        for c in piece:
            v = self.next.get(u << 8 | c)
            if v is None:
                v = self.next[u << 8 | c] = len(self.fail)
                self.fail.append(-1)
                self.pops.append(0)
            u = v
        return u

    def _link(self, ends: set[int]) -> None:
        children: dict[int, list[tuple[int, int]]] = {}
        for key, v in self.next.items():
            children.setdefault(key >> 8, []).append((key & 255, v))
        queue = deque([self.WORD, self.REST])
        while queue:
            u = queue.popleft()
            for c, v in children.get(u, ()):
                if v in ends:
                    self.fail[v], self.pops[v] = self.REST, 1
                else:
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and (z << 8 | c) not in self.next:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.next[z << 8 | c], popped
                queue.append(v)

    def _tail(self, u: int) -> int:
        """Pieces popped from node u to the end of the word; -1 if the rest cannot be spelt."""
        n = 0
        while u > self.REST:
            if self.fail[u] < 0:
                return -1
            n += self.pops[u]
            u = self.fail[u]
        return n

    def count(self, word: bytes) -> int:
        """Number of pieces of a word; -1 if it cannot be spelt."""
        u, n, step, fail, pops = self.WORD, 0, self.next.get, self.fail, self.pops
        for c in word:
            v = step(u << 8 | c)
            while v is None:
                if fail[u] < 0:
                    return -1
                n += pops[u]
                u = fail[u]
                v = step(u << 8 | c)
            u = v
        return n + self.tail[u] if self.tail[u] >= 0 else -1


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 stands for itself, and
    the other bytes, in order, for the letters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def byte_level_vocabulary(path: str) -> tuple[list[bytes], list[bytes]]:
    """(pieces that begin a word, pieces that continue one) of a byte-level vocabulary: those with and
    without a leading space.  Pieces with other white space never occur within a word and go."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    pieces = [bytes(letters[c] for c in p) for p in vocabulary if all(c in letters for c in p)]
    initial = [p[1:] for p in pieces if p[:1] == b" " and p[1:] and p[1:].split() == [p[1:]]]
    return initial, [p for p in pieces if p.split() == [p]]


def token_counts(spark: SparkSession, initial: list[bytes], continuing: list[bytes]):
    """text column -> struct column: n_words, n_tokens, n_unknown.  Words are cut at ASCII white space.
    The vocabulary, whose size is fixed, is broadcast."""
    small_batches(spark)
    pieces = spark.sparkContext.broadcast((initial, continuing))

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Memo(Automaton(*pieces.value).count)
        for batch in batches:
            out = []
            for text in batch.cast(pa.binary()).to_pylist():
                own = list(map(known.__getitem__, text.split())) if text else []
                bad = own.count(-1)
                out.append({"n_words": len(own), "n_tokens": sum(own) + 2 * bad, "n_unknown": bad})
            yield pa.array(out, _ARROW)

    udf = F.arrow_udf(count, TYPE)
    return lambda column: udf(F.col(column) if isinstance(column, str) else column)
