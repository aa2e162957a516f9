"""Scores of texts under a hierarchical Pitman-Yor model of word pairs that is learnt from the corpus itself.

Every word of the training texts is a customer in the restaurant of the word before it (the end before the first one);
the restaurants of all contexts share one parent, the restaurant without context, whose own parent is uniform over the
known words and one unknown.  The customers of the shared parent are the tables of its children.  Seating is sampled
by Gibbs steps (see pitman_yor), in rounds: all contexts given the parent's last probabilities, then the parent given
their tables.  The probability of a word is the average over the kept rounds.

The work is dealt out by Spark.  A task reads a block of documents and knows its words by numbers of its own; word
buckets count words and number them, most frequent first; context buckets merge the blocks' pairs and hold the
restaurants; and what a block needs of the model comes back to it, so no task needs the whole of it.  A context with
more than a bucket's share of the corpus is dealt over several buckets, which share the number of its tables.  Rows carry
packed arrays, sorted by sender, so that a task that is run again does the same.

Defined cases: null and empty texts are the end alone; a null id counts as the empty text for the fold; rows that repeat
are scored, and learnt from, each; a corpus without training rows knows no word, and every token has probability one;
an empty table gives an empty result; of the caller's columns only the id is kept.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, small_batches
from .pitman_yor import discount, draw_tables, stirling_table

DOCS, WORDS, SIZE, IDS, PAIRS, COUNTS, FIXED, SINGLES, WANTED, TABLES, SEATS, SPLIT, ROOT, BASE, STATS, ANSWER, CHANCE = range(17)
ROWS = "to bigint, of bigint, kind int, a bigint, b bigint, body binary"
END = b""


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; whole numbers from 0 on in the narrowest type, bytes of equal weight together."""
    head, parts = [], []
    for x in map(np.ascontiguousarray, arrays):
        if x.dtype.kind in "iub" and (not x.size or x.min() >= 0):
            x = x.astype(np.min_scalar_type(int(x.max()) if x.size else 0))
        head.append((x.dtype.str, len(x)))
        parts.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes())
    said = json.dumps(head).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(said).to_bytes(4, "little") + said + b"".join(parts))


def unpacked(body: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(body)
    at = 4 + int.from_bytes(data[:4], "little")
    out = []
    for kind, n in json.loads(data[4:at]):
        kind = np.dtype(kind)
        raw = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n).T
        out.append(np.ascontiguousarray(raw).view(kind).reshape(n).astype(np.int64 if kind.kind in "iu" else kind))
        at += n * kind.itemsize
    return out


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    to, of, kind, a, b, body = zip(*rows) if rows else ((),) * 6
    columns = [pa.array(to, pa.int64()), pa.array(of, pa.int64()), pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(body, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["to", "of", "kind", "a", "b", "body"])


def row(to: int, of: int, kind: int, *arrays: np.ndarray, a: int = 0, b: int = 0) -> tuple:
    return int(to), int(of), kind, int(a), int(b), packed(*arrays) if arrays else None


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 62 bits."""
    y = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    y = (y ^ (y >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((y ^ (y >> np.uint64(31))) >> np.uint64(2)).astype(np.int64)


class Inbox(dict):
    """What came to one address: kind -> [(sender, arrays, a, b)] by sender."""

    def __init__(self, rows: pa.Table):
        super().__init__()
        for of, kind, a, b, body in sorted(zip(*(rows.column(x).to_pylist() for x in ("of", "kind", "a", "b", "body"))), key=lambda r: r[:2]):
            self.setdefault(kind, []).append((of, unpacked(body) if body is not None else [], a, b))

    def of(self, kind: int) -> list[tuple]:
        return self.get(kind, [])


def deliver(rows: DataFrame, task: Callable[[int, Inbox], list[tuple]]) -> DataFrame:
    """`task(address, inbox)` for every address of `rows`; gives the rows it sends."""
    return rows.groupBy("to").applyInArrow(lambda key, own: pa.Table.from_batches([batch_of(task(key[0].as_py(), Inbox(own)))]), ROWS)


def read_blocks(buckets: int, most: int) -> Callable:
    """(id, held out, text) -> rows for word buckets and, for the block itself, its documents in the block's numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        known, ids, held, codes, size = {END: 0}, [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            words = list(known)
            sizes, flat = np.array([len(c) for c in codes], np.int64), np.concatenate(codes)
            out = np.repeat(np.concatenate(held), sizes)
            times = np.bincount(flat[~out], minlength=len(words))
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            rows = []
            for k in np.unique(bucket).tolist():
                own = np.flatnonzero(bucket == k)
                rows.append(row(k, block, WORDS, np.frombuffer(b"\n".join(words[i] for i in own.tolist()), np.uint8), times[own]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", ids[0].type)])) as w:
                for x in ids:
                    w.write_batch(pa.RecordBatch.from_arrays([x], names=["id"]))
            rows.append(row(block, block, DOCS, np.frombuffer(sink.getvalue(), np.uint8), np.concatenate(held), sizes, flat, bucket))
            yield batch_of(rows)

        for batch in batches:
            ids.append(batch.column(0))
            held.append(batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
            number = known.setdefault
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words = text.lower().split() if text else ()
                codes.append(np.array([*[number(w, len(known)) for w in words], 0], np.int32))
                size += len(text or b"")
            if size >= most:
                yield from flush()
                known, ids, held, codes, size, block = {END: 0}, [], [], [], 0, block + 1
        if codes:
            yield from flush()

    return run


def number_words(buckets: int) -> Callable:
    """Word bucket: counts over all blocks; word number = rank * buckets + bucket, unknown ones (no training) none."""

    def task(bucket: int, inbox: Inbox) -> list[tuple]:
        known, sent, times = {}, [], []
        for block, (said, n), _, _ in inbox.of(WORDS):
            own = np.array([known.setdefault(w, len(known)) for w in said.astype(np.uint8).tobytes().split(b"\n")], np.int64)
            sent.append((block, own))
            times.append(n)
        count = np.bincount(np.concatenate([own for _, own in sent]), weights=np.concatenate(times), minlength=len(known)).astype(np.int64)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        rank[count == 0] = -1
        rows = [row(block, bucket, IDS, rank[own] + 1, count[own]) for block, own in sent]
        return [*rows, row(-1, bucket, SIZE, a=int((count > 0).sum()), b=int(count.sum()))]

    return task


class Block:
    """The documents of a block with the numbers and counts of its words, and its distinct word pairs."""

    def __init__(self, inbox: Inbox, buckets: int, tokens: int):
        ((_, (ids, held, self.sizes, flat, bucket), _, _),) = inbox.of(DOCS)
        self.ids, self.held = ids, held.astype(bool)
        self.word, self.count = np.full(len(bucket), -1, np.int64), np.zeros(len(bucket), np.int64)
        self.places = {}  # of the words of each bucket among the block's own
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k, (rank, n), _, _ in inbox.of(IDS):
            own = self.places[k] = order[bounds[k] : bounds[k + 1]]
            self.word[own], self.count[own] = np.where(rank > 0, (rank - 1) * buckets + k, -1), n
        before = np.concatenate([np.zeros(1, np.int64), flat[:-1]])  # the end (0) closes each document and so opens the next
        out = np.repeat(self.held, self.sizes)
        both, times = np.unique((before * len(bucket) + flat) * 2 + out, return_counts=True)
        pair, first = np.unique(both >> 1, return_index=True)
        self.trained = np.add.reduceat(np.where(both & 1, 0, times), first) if len(pair) else pair
        del both, times, out
        self.context, self.follower = pair // len(bucket), pair % len(bucket)
        self.flat, self.pair_at, self.buckets = flat, np.searchsorted(pair, before * len(bucket) + flat), buckets
        # Where pairs go: contexts with more than a bucket's share of the tokens by their follower too.
        parts = 1 + self.count[self.context] * buckets // max(1, tokens)
        part = np.where(parts > 1, mixed(np.maximum(self.word[self.follower], 0)) % parts, 0)
        self.bucket = mixed(self.word[self.context] * 1_000_003 + part) % buckets

    def requests(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, contexts, number of known followers of each, pairs): known contexts, and pairs of known words by
        (context, follower) number.  A context without known followers is asked for too."""
        use = np.flatnonzero(self.count[self.context] > 0)
        order = use[np.lexsort((self.word[self.follower[use]], self.word[self.context[use]], self.bucket[use]))]
        bounds = np.searchsorted(self.bucket[order], np.arange(self.buckets + 1))
        for k in range(self.buckets):
            own = order[bounds[k] : bounds[k + 1]]
            if len(own):
                contexts, first = np.unique(self.word[self.context[own]], return_index=True)
                known = self.count[self.follower[own]] > 0
                runs = np.add.reduceat(known.astype(np.int64), first)
                yield k, self.context[own[first]], runs, own[known]


def send_pairs(buckets: int, tokens: int) -> Callable:
    def task(block: int, inbox: Inbox) -> list[tuple]:
        own = Block(inbox, buckets, tokens)
        return [row(k, block, PAIRS, np.diff(own.word[contexts], prepend=0), own.count[contexts], runs, own.word[own.follower[pairs]], own.trained[pairs]) for k, contexts, runs, pairs in own.requests()]

    return task


def merged(inbox: Inbox):
    """Pairs of all blocks -> (contexts, their counts, context and word of each trained pair, its customers, and for each
    block the place of its contexts and of its pairs, -1 for those nobody trained)."""
    sent = [(block, np.cumsum(step), counts, runs, words, n) for block, (step, counts, runs, words, n), _, _ in inbox.of(PAIRS)]
    contexts, at = np.unique(np.concatenate([s[1] for s in sent]), return_inverse=True)
    counts = np.zeros(len(contexts), np.int64)
    counts[at] = np.concatenate([s[2] for s in sent])
    words, word_at = np.unique(np.concatenate([s[4] for s in sent]), return_inverse=True)
    key = np.repeat(at, np.concatenate([s[3] for s in sent])) * max(1, len(words)) + word_at
    keys, place = np.unique(key, return_inverse=True)
    customers = np.bincount(place, weights=np.concatenate([s[5] for s in sent]), minlength=len(keys)).astype(np.int64)
    real = np.cumsum(customers > 0) - 1
    place = np.where(customers[place] > 0, real[place], -1)
    keys, customers = keys[customers > 0], customers[customers > 0]
    back, i, j = [], 0, 0
    for block, own, _, _, asked, _ in sent:
        back.append((block, at[i : i + len(own)], place[j : j + len(asked)]))
        i, j = i + len(own), j + len(asked)
    context, word = keys // max(1, len(words)), words[keys % max(1, len(words))]
    return contexts, counts, context, word, customers, back


def open_restaurants(buckets: int, tokens: int) -> Callable:
    """Context bucket: the pairs with several customers stay here; of each word, how often it has one customer in a
    context (one table, always) and which words will be asked for go to the word's bucket."""

    def task(bucket: int, inbox: Inbox) -> list[tuple]:
        contexts, counts, context, word, customers, _ = merged(inbox)
        once = customers == 1
        single = np.bincount(context[once], minlength=len(contexts))
        wanted, at = np.unique(word[~once], return_inverse=True)
        rows = [row(bucket, bucket, FIXED, np.diff(contexts, prepend=0), counts, single, context[~once], at, customers[~once], wanted), row(-1, bucket, STATS, a=int(once.sum()), b=int((customers == 2).sum()))]
        alone, times = np.unique(word[once], return_counts=True)
        several = np.bincount(at, minlength=len(wanted))
        for k in range(buckets):
            mine, asked = alone % buckets == k, wanted % buckets == k
            if mine.any():
                rows.append(row(k, bucket, SINGLES, alone[mine] // buckets, times[mine]))
            if asked.any():
                rows += [row(k, bucket, WANTED, wanted[asked] // buckets), row(k, bucket, TABLES, several[asked])]
        many = np.flatnonzero(counts * buckets // max(1, tokens) >= 1)
        if len(many):
            rows.append(row(-1, bucket, SPLIT, contexts[many], (single + np.bincount(context[~once], minlength=len(contexts)))[many]))
        return rows

    return task


def seat_parent(words: int, seed: int, settings: dict | None) -> Callable:
    """Word bucket: customers of its words in the shared parent (the tables of all contexts) and tables they sit at."""

    def task(bucket: int, inbox: Inbox) -> list[tuple]:
        asked = {of: ranks for of, (ranks,), _, _ in inbox.of(WANTED)}
        tables = {of: n for of, (n,), _, _ in inbox.of(TABLES)}
        places = [*(x[1] for x in inbox.of(SINGLES)), *([asked[k], tables[k]] for k in asked)]
        n = np.bincount(np.concatenate([p[0] for p in places]), weights=np.concatenate([p[1] for p in places])).astype(np.int64)
        seats = np.minimum(n, 1)
        if settings is not None:
            ((_, (_, last), _, _),) = inbox.of(ROOT)
            own, rng = np.flatnonzero(n), np.random.default_rng([seed, bucket])
            last = np.minimum(last[own], n[own])
            seats[own] = draw_tables(n[own], np.maximum(settings["tables"] - last, 0).astype(float), np.ones(len(own)), np.full(len(own), words + 1.0), False, settings["d"], settings["strength"], rng, stirling_table(settings["d"]))
        return [row(bucket, bucket, ROOT, n, seats, a=int(n.sum()), b=int(seats.sum())), row(-1, bucket, STATS, a=int((n == 1).sum()), b=int((n == 2).sum())), *(row(k, bucket, BASE, n[r], seats[r]) for k, r in asked.items())]

    return task


def mass(n, seats, root: dict, words: int):
    """What the shared parent holds for words with n customers at `seats` tables (0 and 0: any unknown one)."""
    return n - root["d"] * seats + (root["strength"] + root["d"] * root["tables"]) / (words + 1)


def chance(n, seats, root: dict, words: int):
    """Their probability there."""
    return mass(n, seats, root, words) / (root["strength"] + root["customers"])


def seat_contexts(buckets: int, words: int, root: dict, leaf: dict, shared: dict, seed: int, turns: int) -> Callable:
    """Context bucket: each pair's tables drawn anew, in `turns` parts, given the parent's probabilities."""

    def task(bucket: int, inbox: Inbox) -> list[tuple]:
        ((_, (step, counts, single, context, at, customers, wanted), _, _),) = inbox.of(FIXED)
        contexts = np.cumsum(step)
        last = next((x[1][0] for x in inbox.of(SEATS)), np.ones(len(customers), np.int64))
        above, above_seats = np.zeros(len(wanted)), np.zeros(len(wanted))  # in the shared parent
        for k, found, _, _ in inbox.of(BASE):
            above[wanted % buckets == k], above_seats[wanted % buckets == k] = found
        elsewhere = np.zeros(len(contexts), np.int64)  # tables of the parts of a context in other buckets
        here = single + np.bincount(context, weights=last, minlength=len(contexts)).astype(np.int64)
        for i in np.flatnonzero(np.isin(contexts, list(shared))).tolist() if shared else ():
            elsewhere[i] = shared[int(contexts[i])] - here[i]
        rng, table, seats = np.random.default_rng([seed, bucket]), stirling_table(leaf["d"]), last.copy()
        turn = mixed(np.arange(len(customers))) % turns
        for k in range(turns):
            own = np.flatnonzero(turn == k)
            tables = elsewhere + single + np.bincount(context, weights=seats, minlength=len(contexts))
            rest = np.maximum(above[at[own]] - last[own], 0)  # without this pair's own tables
            p = mass(rest, np.minimum(above_seats[at[own]], rest), root, words), root["strength"] + root["customers"] - last[own]
            seats[own] = draw_tables(customers[own], np.maximum(tables[context[own]] - seats[own], 0), *p, True, leaf["d"], leaf["strength"], rng, table)
        here = single + np.bincount(context, weights=seats, minlength=len(contexts)).astype(np.int64)
        several = np.bincount(at, weights=seats, minlength=len(wanted)).astype(np.int64)
        rows = [row(bucket, bucket, SEATS, seats)]
        many = np.flatnonzero(counts * buckets // max(1, leaf["tokens"]) >= 1)
        if len(many):
            rows.append(row(-1, bucket, SPLIT, contexts[many], here[many]))
        return rows + [row(k, bucket, TABLES, several[own]) for k in range(buckets) if (own := wanted % buckets == k).any()]

    return task


def answer_pairs(shared: list[dict]) -> Callable:
    """Context bucket: to each block, of its pairs the customers and the tables in all kept rounds together, and of its
    contexts the tables in each kept round."""

    def task(bucket: int, inbox: Inbox) -> list[tuple]:
        contexts, _, context, _, customers, back = merged(inbox)
        once, kept = customers == 1, [x[1][0] for x in sorted(inbox.of(SEATS), key=lambda x: x[2])]
        seats, tables = np.where(once, len(kept), 0), []
        for k, own in enumerate(kept):
            seats[~once] += own
            here = np.bincount(context[once], minlength=len(contexts)) + np.bincount(context[~once], weights=own, minlength=len(contexts)).astype(np.int64)
            for i in np.flatnonzero(np.isin(contexts, list(shared[k]))).tolist() if shared[k] else ():
                here[i] = shared[k][int(contexts[i])]
            tables.append(here)
        customers, seats = np.append(customers, 0), np.append(seats, 0)  # -1: nobody
        return [row(block, bucket, ANSWER, customers[pairs], seats[pairs], *(t[own] for t in tables)) for block, own, pairs in back]

    return task


def answer_words(bucket: int, inbox: Inbox) -> list[tuple]:
    """Word bucket: to each block, its words' customers and tables in the shared parent in each kept round."""
    kept = [x[1] for x in sorted(inbox.of(ROOT), key=lambda x: x[2])]
    out = []
    for block, (rank, _), _, _ in inbox.of(IDS) if kept else ():  # without training rows no word is known
        own = rank[rank > 0] - 1
        out.append(row(block, bucket, CHANCE, *(x[own] for n_seats in kept for x in n_seats)))
    return out


def score_block(buckets: int, tokens: int, words: int, roots: list[dict], leaf: dict, id_type: pa.DataType) -> Callable:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        inbox = Inbox(rows)
        own = Block(inbox, buckets, tokens)
        n_rounds = len(roots)
        base = [np.full(len(own.word), chance(0, 0, r, words)) for r in roots]
        for k, found, _, _ in inbox.of(CHANCE):
            at = own.places[k][own.word[own.places[k]] >= 0]
            for s in range(n_rounds):
                base[s][at] = chance(found[2 * s], found[2 * s + 1], roots[s], words)
        answers = {k: found for k, found, _, _ in inbox.of(ANSWER)}
        customers, seats = np.zeros(len(own.context)), np.zeros(len(own.context))
        tables = [np.zeros(len(own.context)) for _ in roots]
        for k, contexts, _, pairs in own.requests():
            found = answers[k]
            customers[pairs], seats[pairs] = found[0], found[1]
            of_context = np.zeros(len(own.word))
            mine = np.flatnonzero((own.bucket == k) & (own.count[own.context] > 0))
            for s in range(n_rounds):
                of_context[contexts] = found[2 + s]
                tables[s][mine] = of_context[own.context[mine]]
        whole = leaf["strength"] + own.count[own.context]
        p = (customers - leaf["d"] * seats / n_rounds) / whole
        for s in range(n_rounds):
            p += (leaf["strength"] + leaf["d"] * tables[s]) / whole * base[s][own.follower] / n_rounds
        ends = np.cumsum(own.sizes)
        sums = [np.diff(np.concatenate([[0.0], np.cumsum(x)])[np.concatenate([[0], ends])]) for x in (own.count[own.flat] > 0, np.log10((own.count[own.flat] + 1) / (tokens + words + 1)), np.log10(p)[own.pair_at])]
        ids = pa.ipc.open_stream(own.ids.astype(np.uint8).tobytes()).read_all().column(0)
        columns = [ids, pa.array(own.held), pa.array(own.sizes), pa.array(np.rint(sums[0]).astype(np.int64)), pa.array(np.full(len(ends), tokens)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.Table.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def shared_tables(rows: DataFrame) -> dict[int, int]:
    """Tables of the contexts that are dealt over several buckets: at most two entries a bucket."""
    out: dict[int, int] = {}
    for r in rows.where(F.col("kind") == SPLIT).select("body").collect():
        for context, n in zip(*(x.tolist() for x in unpacked(r["body"]))):
            out[context] = out.get(context, 0) + n
    return out


def score_texts(documents: DataFrame, held_out: Column, rounds: int = 4, kept: int = 3, turns: int = 3, strength: float = 1.0, seed: int = 13, block: int = 12 << 20, bucket: int = 16 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed word counts) and score, the model's
    log10 probability of the text.  Rows where `held_out` is true are not learnt from; null counts as false.

    `block` bounds the bytes of text a task holds; there is a bucket for each `bucket` bytes of all texts."""
    spark = documents.sparkSession
    small_batches(spark)
    read = documents.select(F.col(doc_id).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).cast("string").alias("text"))
    id_type = read.schema["id"].dataType
    buckets = 1 + (read.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket

    def of(rows: DataFrame, *kinds: int) -> DataFrame:
        return rows.where(F.col("kind").isin(*kinds) & (F.col("to") >= 0))

    def total(rows: DataFrame, kind: int) -> tuple[int, int]:
        a, b = rows.where(F.col("kind") == kind).agg(F.sum("a"), F.sum("b")).first()
        return a or 0, b or 0

    texts = cut(read.mapInArrow(read_blocks(buckets, block), ROWS))
    numbers = cut(deliver(of(texts, WORDS), number_words(buckets)))
    words, tokens = total(numbers, SIZE)
    of_blocks = of(texts, DOCS).unionByName(of(numbers, IDS))
    pairs = cut(deliver(of_blocks, send_pairs(buckets, tokens)))
    opened = cut(deliver(pairs, open_restaurants(buckets, tokens)))
    leaf = {"d": discount(*total(opened, STATS)), "strength": strength, "tokens": tokens}
    parent = cut(deliver(of(opened, SINGLES, WANTED, TABLES), seat_parent(words, seed, None)))
    root_d = discount(*total(parent, STATS))

    def settings(rows: DataFrame) -> dict:
        customers, tables = total(rows, ROOT)
        return {"d": root_d, "strength": strength, "customers": customers, "tables": tables}

    root, seats, shared = settings(parent), None, shared_tables(opened)
    samples: list[tuple[DataFrame, DataFrame, dict, dict]] = []
    for k in range(rounds):
        inputs = of(opened, FIXED).unionByName(of(parent, BASE))
        seats = cut(deliver(inputs if seats is None else inputs.unionByName(of(seats, SEATS)), seat_contexts(buckets, words, root, leaf, shared, seed + 2 * k, turns)))
        shared = shared_tables(seats)
        parent = cut(deliver(of(opened, SINGLES, WANTED).unionByName(of(seats, TABLES)).unionByName(of(parent, ROOT)), seat_parent(words, seed + 2 * k + 1, root)))
        root = settings(parent)
        samples.append((seats, parent, root, shared))
    drop(opened)
    samples = samples[-kept:]
    answers, chances = pairs, of(numbers, IDS).select(F.col("of").alias("to"), F.col("to").alias("of"), "kind", "a", "b", "body")
    for k, (own_seats, own_parent, _, _) in enumerate(samples):
        answers = answers.unionByName(of(own_seats, SEATS).withColumn("a", F.lit(k).cast("bigint")))
        chances = chances.unionByName(of(own_parent, ROOT).withColumn("a", F.lit(k).cast("bigint")))
    found = deliver(answers, answer_pairs([s[3] for s in samples])).unionByName(deliver(chances, answer_words))
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return of_blocks.unionByName(found).groupBy("to").applyInArrow(score_block(buckets, tokens, words, [s[2] for s in samples], leaf, to_arrow_type(id_type)), schema)
