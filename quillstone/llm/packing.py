"""Best-fit packing of token sequences with large-item matching.

Documents longer than the capacity are cut into full pieces (which need no packing) and a first piece with
the rest.  Pieces fit by length alone, so the plan is made over the histogram of lengths, which has at most
`capacity` entries however many documents there are:

* Lengths above a third of the capacity: at most two go together.  From the longest down, each is matched
  with the longest other one that still fits beside it.
* Shorter ones: from the longest down, each goes to the tightest gap it fits; a new sequence is begun only
  when there is none.

All steps work on runs of equal lengths, never on single documents.  Each piece then finds its place from
its rank among the pieces of its length: a rank within its own task, plus the number in earlier tasks.

Defined cases: null text is the empty text (its ids are the end id alone); repeated rows are packed each;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches
from .tokens import byte_letters

#: How byte-level files split a text before merging (a fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "piece_at int, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, local long"


class Encoder:
    """Ids of whole texts by a byte-level tokenizer file, as little-endian 32-bit numbers.

    Where the file's merges are in the order of their ids, its ids are also those of the ranked byte-pair
    encoder, which is several times faster; texts that hold one of the file's own special tokens, texts whose runs
    are too long for that encoder's splitting (a million blanks), and files with another order or another
    splitting go to the tokenizer itself."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(json.loads(tokenizer_json))

    @staticmethod
    def _ranked(file: dict):
        import tiktoken

        model, cutter, letters = file["model"], file.get("pre_tokenizer") or {}, byte_letters()
        vocabulary, merges = model["vocab"], model.get("merges", [])
        pairs = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
        plain = model["type"] == "BPE" and not file.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
        plain &= cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        if not plain or sorted(vocabulary[c] for c in letters) != list(range(256)) or [vocabulary[p] for p in pairs] != list(range(256, 256 + len(pairs))):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(pairs)}
        return tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.ranked is not None and not any(s in text for s in self.special):
            try:
                return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
            except ValueError:  # its splitting gave up on a long run
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """[(lengths in one sequence, number of such sequences)] that hold `counts[length]` pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    groups: dict[int, list[list]] = {}  # gap -> [[lengths, number]]
    gaps: list[int] = []  # those that some sequence has, sorted

    def put(gap: int, lengths: list[int], number: int) -> None:
        if gap not in groups:
            groups[gap] = []
            insort(gaps, gap)
        groups[gap].append([lengths, number])

    large = sorted(n for n in left if 3 * n > capacity)
    while large:  # the longest, with the longest that fits beside it
        n = large[-1]
        k = bisect_left(large, capacity - n + 1) - 1
        mate = large[k] if k >= 0 else None
        if mate is None:
            number = left[n]
            put(capacity - n, [n], number)
            left[n] = 0
        elif mate == n:
            number = left[n] // 2
            if number:
                put(capacity - 2 * n, [n, n], number)
            left[n] -= 2 * number
            if left[n]:  # a last one, with the next shorter
                other = large[-2] if len(large) > 1 else None
                put(capacity - n - (other or 0), [n, other] if other else [n], 1)
                left[n] = 0
                if other:
                    left[other] -= 1
        else:
            number = min(left[n], left[mate])
            put(capacity - n - mate, [n, mate], number)
            left[n] -= number
            left[mate] -= number
        large = [x for x in large if left[x]]
    for n in sorted((n for n in left if 3 * n <= capacity and n > 0), reverse=True):
        todo = left[n]
        while todo:
            k = bisect_left(gaps, n)
            if k == len(gaps):
                put(capacity, [], -(-todo // (capacity // n)))
                continue
            gap = gaps[k]
            lengths, number = groups[gap].pop()
            if not groups[gap]:
                del groups[gap], gaps[k]
            each = gap // n
            full = min(number, todo // each)
            if full:
                put(gap - each * n, lengths + [n] * each, full)
                todo -= full * each
                number -= full
            if number and todo:  # fewer are left than one sequence takes
                put(gap - todo * n, lengths + [n] * todo, 1)
                todo, number = 0, number - 1
            if number:
                put(gap, lengths, number)
    return [(lengths, number) for own in groups.values() for lengths, number in own if lengths]


def places(packed: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """length -> (first ranks, first sequence ids, offsets): a piece of that length with rank r, in the run i
    that holds r, goes to sequence ids[i] + r - ranks[i]."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for lengths, number in packed:
        offset = 0
        for n in lengths:
            out.setdefault(n, []).append((ranks.get(n, 0), sequence, offset))
            ranks[n] = ranks.get(n, 0) + number
            offset += n
        sequence += number
    return {n: tuple(np.array(x, np.int64) for x in zip(*runs)) for n, runs in out.items()}


def pieces(documents: DataFrame, tokenizer: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece.  `local` is its rank among the pieces of its length in its task `piece_at`."""
    spark = documents.sparkSession
    small_batches(spark)
    with open(tokenizer, encoding="utf-8") as f:
        said = spark.sparkContext.broadcast(f.read())
    last = np.array([end_id], "<u4")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen, task = Encoder(said.value), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for own, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([encoder(value or ""), last])
                total = len(ids)
                first = total % capacity or capacity
                for k, start in enumerate([0, *range(first, total, capacity)]):
                    n = first if k == 0 else capacity
                    rows.append((task, own, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), int(seen[n])))
                    seen[n] += 1
            types = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in types], names=names)

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, PIECES)


def pack(documents: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Texts are tokenised once; the pieces are kept in the shared checkpoint folder."""
    spark = documents.sparkSession
    cutup = cut(pieces(documents, tokenizer, capacity, end_id, doc_id, text))
    by_task = cutup.groupBy("length", "piece_at").agg((F.max("local") + 1).alias("n"))
    earlier = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("piece_at").rowsBetween(Window.unboundedPreceding, -1)))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    where = spark.sparkContext.broadcast(places(plan(histogram, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for length in np.unique(n):
                at = n == length
                ranks, ids, offsets = where.value[int(length)]
                i = np.searchsorted(ranks, rank[at], side="right") - 1
                sequence[at], offset[at] = ids[i] + rank[at] - ranks[i], offsets[i]
            own = [batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cutup.join(earlier.drop("n"), ["length", "piece_at"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.coalesce("before", F.lit(0)) + F.col("local")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
