"""Alignment of two tokenizers over the same texts: minimal groups, links, and how often each id pair is linked.

A (byte-level) encodes a space and the text, B (pieces) the text, to which it adds the space itself.  The tokens of
both, with the bytes they stand for, are the two sides of a graph whose edges join tokens that share bytes.  Union-find
over the edges gives the components: these are exactly the smallest groups that both sides cut out alike.  A component's
links are those of its members that end at the same byte.

Where both vocabularies cut before every blank that follows a non-blank (this is tested when they are loaded), a text is
the sequence of its words, and a distinct word of a task is encoded and aligned once, many words together in numpy.
Each task sums up its links by id pair; Spark adds the pairs up over all texts and hands each block of documents the
counts of its own pairs, so nothing is broadcast but the two vocabularies.

Defined cases: null and empty texts, and texts that either side does not give back byte for byte, have no tokens: zeros
and an empty digest.  Rows are taken one by one, so repeated rows and repeated or null ids stay as they are; an empty
table gives an empty result; of the caller's columns only the id is kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .packing import Encoder
from .tokens import byte_letters

#: A blank after white space: such texts need the exact cut below; elsewhere every blank is one.
ODD_BLANK, CUT = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")


def components(a_start: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token) for two cuts of one byte string into non-empty tokens.

    Every stretch between neighbouring cuts lies in one A and one B token and joins them: an edge.  Of its two ends the
    one that begins later hangs itself below the other, B below A if they begin together; then all paths are halved
    until each node knows its root."""
    n_a, starts = len(a_start), np.union1d(a_start, b_start)
    i = np.searchsorted(a_start, starts, side="right") - 1
    j = np.searchsorted(b_start, starts, side="right") - 1
    parent = np.arange(n_a + len(b_start))
    b_later = a_start[i] <= b_start[j]
    parent[n_a + j[b_later]] = i[b_later]
    parent[i[~b_later]] = n_a + j[~b_later]
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            break
        parent = above
    number = np.cumsum(parent[:n_a] == np.arange(n_a)) - 1  # roots are A tokens, in the order of the text
    return number[parent[:n_a]], number[parent[n_a:]]


class Aligner:
    """Aligned words of two vocabularies, each worked out once while it is remembered."""

    def __init__(self, tokenizer_json: str, piece_model: bytes, words: int = 300_000, characters: int = 16 << 20):
        import sentencepiece

        self.a, self.most, self.most_characters = Encoder(tokenizer_json), words, characters
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        letters, vocabulary = byte_letters(), self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        odd = "ﬁ  Å\t é "
        same = b"".join(self.b_bytes[i] for i in self.b.encode(odd)) == (" " + odd).encode()
        self.blank = self.b.piece_to_id("▁")
        self.by_word = self.a.ranked is not None and same and self.b_bytes[self.blank] == b" " and not any("▁" in p.lstrip("▁") for p in pieces)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.counts = np.zeros((0, 5), np.int64)  # whether it comes back whole; tokens of A, of B; groups; links
        self.link_start, self.links, self.characters = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def words(self, text: str) -> list[str]:
        """The text's words, each without the blank before it."""
        if not self.by_word:
            return [text]
        return [x[1:] for x in CUT.split(" " + text)] if ODD_BLANK.search(" " + text) else text.split(" ")

    def _a_ids(self, text: str) -> list[int]:
        if self.a.ranked is not None:
            try:
                return self.a.ranked.encode_ordinary(text)
            except ValueError:  # its splitting gave up on a long run
                pass
        return self.a.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, words: list[str]) -> None:
        """Align words that are not yet known."""
        a_ids = [self._a_ids(" " + w) for w in words]
        b_ids = self.b.encode(words, num_threads=1)
        if self.by_word:
            b_ids = [x if w else [self.blank] for w, x in zip(words, b_ids)]
        whole = [b"".join(map(self.a_bytes.__getitem__, x)) == (said := (" " + w).encode()) and b"".join(map(self.b_bytes.__getitem__, y)) == said for w, x, y in zip(words, a_ids, b_ids)]
        a_ids, b_ids = ([x if ok else [] for x, ok in zip(ids, whole)] for ids in (a_ids, b_ids))
        a, b = (np.array([i for x in ids for i in x], np.int64) for ids in (a_ids, b_ids))
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        of_a, of_b = components(a_end - self.a_length[a], b_end - self.b_length[b])
        n = int(of_a[-1]) + 1 if len(of_a) else 0
        a_last, b_last = (np.searchsorted(own, np.arange(n), side="right") - 1 for own in (of_a, of_b))
        together = a_end[a_last] == b_end[b_last]  # no other members of a component end together, or it would be two
        word_of = np.repeat(np.arange(len(words)), n_a)[a_last]
        n_groups, n_links = np.bincount(word_of, minlength=len(words)), np.bincount(word_of[together], minlength=len(words))
        said, a_said, b_said = [], list(map(str, a.tolist())), list(map(str, b.tolist()))
        i = j = 0
        for x, y in zip((a_last + 1).tolist(), (b_last + 1).tolist()):
            said.append(f"{a_said[i]}|{b_said[j]}" if x == i + 1 and y == j + 1 else f"{','.join(a_said[i:x])}|{','.join(b_said[j:y])}")
            i, j = x, y
        ends = np.cumsum(n_groups).tolist()
        self.groups += [";".join(said[x:y]) for x, y in zip([0, *ends], ends)]
        self.counts = np.vstack([self.counts, np.column_stack([np.array(whole, np.int64), n_a, n_b, n_groups, n_links])])
        self.link_start = np.concatenate([self.link_start, len(self.links) + np.cumsum(n_links) - n_links])
        self.links = np.concatenate([self.links, (a[a_last] << 32 | b[b_last])[together]])
        self.characters += sum(map(len, words)) + sum(map(len, said))

    def codes(self, texts: list[str]) -> list[list[int]]:
        """The numbers of each text's words, all of them known from then on."""
        if len(self.known) > self.most or self.characters > self.most_characters:
            self.forget()
        known, cut = self.known, [self.words(t) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(w for own in cut for w in own) if w not in known]
        known.update(zip(new, range(len(known), len(known) + len(new))))
        if new:
            self.learn(new)
        return [[known[w] for w in own] for own in cut]


def slices(texts: list[str | None], characters: int = 2 << 20) -> Iterator[slice]:
    """Runs of texts of about so many characters; a longer text is alone in its run."""
    first = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > characters:
            yield slice(first, k)
            first, size = k, 0
        size += len(t or "")
    if first < len(texts):
        yield slice(first, len(texts))


PAIR_ROWS = "block bigint, body binary, pair bigint, times bigint"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _blocks(tokenizer_json, piece_model, id_type: pa.DataType, characters: int):
    """Batches of (id, text) -> per block of about `characters` characters one row with its documents and, for each
    id pair linked in it, one with the number of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = Aligner(tokenizer_json.value, piece_model.value), TaskContext.get().partitionId() << 32
        parts, sums, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            pairs, at = np.unique(np.concatenate([s[0] for s in sums]), return_inverse=True)
            times = np.bincount(at, weights=np.concatenate([s[1] for s in sums]), minlength=len(pairs)).astype(np.int64)
            begin, out = 0, []
            for part, (own, _) in zip(parts, sums):  # from numbers within a slice to numbers within the block
                link = part.column("link")
                values = pa.array(at[begin : begin + len(own)].astype(np.int32)).take(link.values)
                out.append(part.set_column(part.schema.get_field_index("link"), "link", pa.ListArray.from_arrays(link.offsets, values)))
                begin += len(own)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, out[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for x in out:
                    w.write_batch(x)
            for k in range(0, max(1, len(pairs)), 200_000):
                p, n = pairs[k : k + 200_000], times[k : k + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), block)), pa.nulls(len(p), pa.binary()), pa.array(p), pa.array(n)], names=["block", "body", "pair", "times"])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=["block", "body", "pair", "times"])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for run_ in slices(texts):
                own = texts[run_]
                codes = aligner.codes(own)
                n_words = np.array([len(c) for c in codes], np.int64)
                flat, doc = np.array([c for own_ in codes for c in own_], np.int64), np.repeat(np.arange(len(own)), n_words)
                broken = np.bincount(doc[aligner.counts[flat, 0] == 0], minlength=len(own)) > 0
                keep = ~broken[doc]
                flat, doc = flat[keep], doc[keep]
                counts = [np.bincount(doc, weights=aligner.counts[flat, k], minlength=len(own)).astype(np.int64) for k in (1, 2, 3, 4)]
                n_links = aligner.counts[flat, 4]
                where = np.arange(n_links.sum()) + np.repeat(aligner.link_start[flat] - (np.cumsum(n_links) - n_links), n_links)
                pairs, at = np.unique(aligner.links[where], return_inverse=True)
                cell, times = np.unique(np.repeat(doc, n_links) * max(1, len(pairs)) + at, return_counts=True)
                link_doc, link = np.divmod(cell, max(1, len(pairs)))
                offsets = pa.array(np.searchsorted(link_doc, np.arange(len(own) + 1)).astype(np.int32))
                texts_of = [";".join(map(aligner.groups.__getitem__, c)) if c and not bad else "" for c, bad in zip(codes, broken.tolist())]
                digests = pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts_of])
                parts.append(pa.RecordBatch.from_arrays(
                    [batch.column(0)[run_].cast(id_type), *map(pa.array, counts), digests, pa.ListArray.from_arrays(offsets, pa.array(link.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))],
                    names=["id", *COUNTS, "groups_sha256", "link", "times"],
                ))
                sums.append((pairs, np.bincount(at, minlength=len(pairs))))
                size += sum(len(t or "") for t in own)
                if size >= characters:
                    yield from flush()
                    parts, sums, size, block = [], [], 0, block + 1
        if parts:
            yield from flush()

    return run


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, count, best: how many links of the corpus hold the pair, and whether no pair of the same B id has more."""
    counted = rows.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    most = counted.groupBy("b").agg(F.max("count").alias("most"))
    return counted.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(documents: DataFrame, tokenizer: str, piece_model: str, doc_id: str = "doc_id", text: str = "text", characters: int = 16 << 20) -> DataFrame:
    """One row per document: its id as `doc_id`, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    `characters` bounds a block, whose documents (without texts) and pairs meet in one task."""
    spark = documents.sparkSession
    small_batches(spark)
    with open(tokenizer, encoding="utf-8") as f, open(piece_model, "rb") as g:
        a, b = spark.sparkContext.broadcast(f.read()), spark.sparkContext.broadcast(g.read())
    read = documents.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(read.schema["id"].dataType)
    kept = cut(read.mapInArrow(_blocks(a, b, id_type, characters), PAIR_ROWS))
    rows = kept.where(F.col("pair").isNotNull()).select("block", "pair", "times")
    known = rows.drop("times").join(pair_counts(rows), "pair")

    def finish(key: tuple, bodies: pa.Table, answers: pa.Table) -> pa.Table:
        """A block's documents, with the counts of its pairs in the order of the pairs."""
        answers = answers.sort_by("pair")
        count, best = (answers.column(x).to_numpy() for x in ("count", "best"))
        out = []
        for part in pa.ipc.open_stream(bodies.column("body")[0].as_py()):
            link, times = part.column("link"), part.column("times").values.to_numpy()
            at, ends = link.values.to_numpy(), link.offsets.to_numpy()
            sums = [np.concatenate([[0], np.cumsum(own)]) for own in (times * best[at].astype(np.int64), times * count[at])] if len(at) else [np.zeros(1, np.int64)] * 2
            n_best, count_sum = (s[ends[1:]] - s[ends[:-1]] for s in sums)
            out.append(pa.Table.from_arrays([part.column("id"), *(part.column(x) for x in COUNTS), pa.array(n_best), pa.array(count_sum), part.column("groups_sha256")], names=NAMES))
        return pa.concat_tables(out)

    schema = f"doc_id {read.schema['id'].dataType.simpleString()}, " + ", ".join(f"{x} bigint" for x in NAMES[1:-1]) + ", groups_sha256 string"
    bodies = kept.where(F.col("body").isNotNull()).select(F.col("block").alias("of"), "body")
    return bodies.groupBy("of").cogroup(known.groupBy("block")).applyInArrow(finish, schema)


NAMES = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]
