"""N-gram Jaccard join by rare-first prefix filtering, and the components of its links.

Steps, all over whole texts:

1. Each text becomes its set of word n-grams (64-bit hashes).  Texts with equal sets are one class, known by
   64 bits of the set's digest; copies are never paired.
2. A table of fixed size counts the n-grams of the corpus by bucket.  It gives one order for all sets, rare
   n-grams first.  Two sets that are similar enough share an n-gram among the first
   n - ceil(t n) + 1 of each (prefix filter), so only these are shuffled, by n-gram, without texts.
3. Within an n-gram, classes are in order of size.  Of two classes the length filter and the positional filter
   (what can still follow the shared n-gram) must leave a chance; classes that no other one has a chance with go.
4. The first round takes for each class in each n-gram the smallest one that it has a chance with (of the
   n-gram's first one and the WINDOW before it) and keeps, of these, the one that most n-grams name.  So a group of
   near copies needs one verification for each member, and its links are stars, whose components are soon found.
5. Further rounds look at the classes of an n-gram that are not all in one component by now.  While the pairs
   left are many for the rows (MANY a row) and a round takes away a third of them, each class outside the n-gram's largest component is tried with up to TRIES
   others of other components, picked by hash, so that groups grow together.  The last round takes every pair
   with a chance, however far apart, that is left in different components and was not tried.  So no link
   between different texts is lost.
6. Pairs must pass the suffix filter before their texts are fetched: with counts of each set in parts of the
   hash range, the sum of their differences bounds the symmetric difference from below.  What passes is
   verified once, from the two texts; the texts of a pair meet at the place of one of them.
7. Components by alternating stars.

Hot n-grams.  Where one n-gram is in more than SPLIT texts of a batch, that batch's classes are dealt into
blocks of SPLIT, and only the first of each block also goes to the n-gram's common place.  In further rounds an
n-gram with more than BLOCK classes is dealt into units: the classes of its largest component are cut into
blocks, each of which meets the blocks of the others, and pairs must pass a coarse suffix filter there.

Defined cases: null texts and texts without words have empty sets and are linked with nothing; a row without
doc_id takes no part in links and has no component; rows that repeat an id each go with their own text; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import cut, drop, few, free_name, packed, small_batches
from .components import components
from .shingles import Hasher, mix, text_buffers

BITS, BLOCKS = 20, 16
WINDOW = 64  # classes before a class that the first round looks at
SPLIT = 32
MANY, TRIES, ROUNDS = 2, 4, 6
BLOCK = 4096
COARSE = 64
_U = np.uint64
PREFIX = "token bigint, salt int, cid bigint, n int, pos int"
MET = "token bigint, cid bigint, n int, pos int, a bigint, b bigint"


def parts(n: int) -> int:
    """Parts of the hash range in the sketch of a set of n: a power of two, about an eighth of n."""
    return max(COARSE, 1 << (n // 8 | 1).bit_length() - 1)


def sketch(s: np.ndarray) -> bytes:
    k = parts(len(s))
    return np.minimum(np.bincount((s >> _U(64 - k.bit_length() + 1)).astype(np.int64), minlength=k), 255).astype(np.uint8).tobytes()


def folded(own: bytes, k: int) -> np.ndarray:
    """A sketch in k parts."""
    return np.frombuffer(own, np.uint8).reshape(k, -1).sum(1, dtype=np.int32)


def class_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def digest_of(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _scan(size: int, num: int, den: int, counts):
    """Two scans of texts: with no counts, the rows of each text and the counts; else the prefixes."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, seen = Hasher(size), np.zeros(1 << BITS, np.uint32), set()
        names = ["doc_id", "n", "digest", "sketch", "block", "counts"]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
        for batch in batches:
            sets = hasher.sets(*text_buffers(batch.column(1)))
            digests = [digest_of(s) for s in sets]
            for s, d in zip(sets, digests):
                if d not in seen:
                    seen = set() if len(seen) > 200_000 else seen
                    seen.add(d)
                    np.add.at(table, (s & _U((1 << BITS) - 1)).astype(np.int64), 1)
            none = [None] * len(sets)
            columns = [batch.column(0), [len(s) for s in sets], digests, [sketch(s) for s in sets], none, none]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names=names)
        cuts = [zlib.compress(x.tobytes(), 1) for x in np.split(table, BLOCKS)]
        none = [None] * BLOCKS
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([none, none, none, none, list(range(BLOCKS)), cuts], types)], names=names)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, seen = Hasher(size), np.frombuffer(counts.value, np.uint32), set()
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for s in hasher.sets(*text_buffers(batch.column(0))):
                n = len(s)
                if not n:
                    continue
                digest = digest_of(s)
                if digest in seen:
                    continue
                seen = set() if len(seen) > 200_000 else seen
                seen.add(digest)
                df = table[(s & _U((1 << BITS) - 1)).astype(np.int64)]
                order = np.argsort(df, kind="stable")[: n - -(-num * n // den) + 1]
                pos = np.flatnonzero(df[order] > 1)  # the only one of its bucket is the only one at all
                out.append((s[order[pos]].view(np.int64), np.full(len(pos), class_of(digest)), np.full(len(pos), n, np.int32), pos.astype(np.int32)))
            if out:
                token, cid, n, pos = (np.concatenate(c) for c in zip(*out))
                salt, lead = blocks_of(token, task, number)
                number += 1
                # The first of each block goes to the common place, too, marked by a position below zero.
                columns = [np.concatenate([c, c[lead]]) for c in (token, salt, cid, n, pos)]
                columns[1][len(token) :] = 0
                columns[4][len(token) :] = -1 - pos[lead]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "salt", "cid", "n", "pos"])

    return first if counts is None else second


def blocks_of(token: np.ndarray, task: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(salt of each row, rows that are the first of a block) of a batch: 0 but for tokens in more than SPLIT rows."""
    salt, lead = np.zeros(len(token), np.int32), np.zeros(0, np.int64)
    order = np.argsort(token, kind="stable")
    edge = np.flatnonzero(np.append(True, token[order][1:] != token[order][:-1]))
    for a, b in zip(edge.tolist(), np.append(edge[1:], len(token)).tolist()) if len(token) and np.diff(edge, append=len(token)).max() > SPLIT else ():
        if b - a > SPLIT:
            block = np.arange(b - a) // SPLIT
            salt[order[a:b]] = [1 + zlib.crc32(f"{task} {number} {k}".encode()) % (1 << 30) for k in block.tolist()]
            lead = np.append(lead, order[a:b][::SPLIT])
    return salt, lead


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of compressed count blocks."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = np.frombuffer(zlib.decompress(data), np.uint32)
            total[block] = total[block] + own if block in total else own
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(t.tobytes(), 1) for t in total.values()], pa.binary())], names=["block", "counts"])


def _with_end(batches):
    yield from batches
    yield None


def passes(j: np.ndarray, i: np.ndarray, n: np.ndarray, rest: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether rows j and i, of sizes n[j] <= n[i], pass the length and positional filters."""
    return (den * n[j] >= num * n[i]) & (np.minimum(rest[i], rest[j]) >= -(-num * (n[i] + n[j]) // (num + den)))


def near(rank: np.ndarray, n: np.ndarray, pos: np.ndarray, num: int, den: int, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (smaller, larger) of one group that pass the length and positional filters, by their distance.

    Groups lie one after another, each in order of size; `rank` is a row's place in its group."""
    n, d = n.astype(np.int64), 1
    rest = n - pos
    i = np.flatnonzero(rank >= 1)
    while len(i) and (most is None or d <= most):
        i = i[den * n[i - d] >= num * n[i]]  # what lies farther is no longer
        ok = passes(i - d, i, n, rest, num, den)
        yield (i - d)[ok], i[ok]
        d += 1
        i = i[rank[i] >= d]


def ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the group, place in it) of rows in order of `keys`."""
    new = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) if len(keys[0]) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    return group, np.arange(len(group)) - np.flatnonzero(new)[group]


def _meet(num: int, den: int, window: int, most: int = 1 << 16):
    """Rows of PREFIX in order: those that have a chance with another one, and pairs (a, b) of the first round."""

    def out(columns: list[np.ndarray], done: int, goes_on: bool) -> Iterator[pa.RecordBatch]:
        token, salt, cid, n, pos = columns
        lead, pos = pos < 0, np.where(pos < 0, -1 - pos, pos)
        group, rank = ranks(token, salt)
        # Groups that are seen in part only, here or in other blocks, keep all rows.
        whole = np.zeros(group[-1] + 1, bool)
        whole[group[lead | (salt > 0) | (rank > window)]] = True
        whole[0] |= done > 0
        whole[-1] |= goes_on
        chance, parent = whole[group], np.full(len(token), -1)
        for a, b in near(rank, n, pos, num, den, window):
            chance[a] = chance[b] = True
            parent[b] = np.where(cid[a] != cid[b], a, parent[b])
        first = np.arange(len(token)) - rank
        ok = passes(first, np.arange(len(token)), n.astype(np.int64), n - pos, num, den) & (cid[first] != cid)
        parent[ok] = first[ok]
        keep = np.flatnonzero(chance & ~lead & (np.arange(len(token)) >= done))
        paired = np.flatnonzero((parent >= 0) & (np.arange(len(token)) >= done))
        none = lambda k, t: pa.nulls(k, t)
        names = ["token", "cid", "n", "pos", "a", "b"]
        yield pa.RecordBatch.from_arrays([*(pa.array(c[keep].astype(t)) for c, t in ((token, np.int64), (cid, np.int64), (n, np.int32), (pos, np.int32))), none(len(keep), pa.int64()), none(len(keep), pa.int64())], names=names)
        yield pa.RecordBatch.from_arrays([*(none(len(paired), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())), pa.array(cid[parent[paired]]), pa.array(cid[paired])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, 0
        for batch in _with_end(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                own = [batch.column(i).to_numpy() for i in range(5)]
                own = own if held is None else [np.append(h, c) for h, c in zip(held, own)]
                token, salt, cid, _, pos = own
                # One class of a group once; a mark of a block's first one stays beside it.
                new = np.append(True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (cid[1:] != cid[:-1]) | ((pos[1:] < 0) != (pos[:-1] < 0)))
                held = [c[new] for c in own]
                other = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
                end = int(other[-1]) + 1 if len(other) else 0
                if not end and len(held[0]) < most:
                    continue
            elif held is None:
                return
            else:
                end = len(held[0])
            goes_on = not end
            yield from out([c[: end or None] for c in held], done, goes_on)
            if batch is None:
                return
            if goes_on:  # its first row and the last ones stay in sight
                held = [np.append(c[:1], c[1:][-window:]) for c in held]
            held, done = (held, len(held[0])) if goes_on else ([c[end:] for c in held], 0)

    return run


def _across(num: int, den: int, seed: int | None = None):
    """Rows (token, i, j, cid, n, pos, comp, side, minor, coarse) in order of unit, n and cid: pairs (a, b, h) with a
    chance in different components, a being outside the largest one (minor).  In a unit of two blocks, only rows of
    different sides meet.  With a seed, only one pair of each such a, that of the least hash h."""

    def out(columns: list) -> pa.RecordBatch:
        token, i, j, cid, n, pos, comp, side, minor, coarse = columns
        _, rank = ranks(token, i, j)
        known = np.array([c is not None for c in coarse], bool)
        told = np.zeros((len(coarse), COARSE), np.int32) if known.any() else None
        if told is not None:
            told[known] = np.frombuffer(b"".join(c for c in coarse if c is not None), np.uint16).reshape(-1, COARSE)
        least, mate = np.full(len(cid), np.iinfo(np.uint64).max, np.uint64), np.full(len(cid), -1)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for a, b in near(rank, n, pos, num, den):
            ok = (comp[a] != comp[b]) & ((i[a] == j[a]) | (side[a] != side[b]))
            a, b = a[ok], b[ok]
            if told is not None and len(a):
                total = n[a].astype(np.int64) + n[b]
                ok = ~known[a] | (np.abs(told[a] - told[b]).sum(1) <= total - 2 * -(-num * total // (num + den)))
                a, b = a[ok], b[ok]
            if seed is None:
                turn = (minor[a] == 0) | ((minor[b] == 1) & (cid[a] > cid[b]))
                found.append((np.where(turn, b, a), np.where(turn, a, b)))
                continue
            h = mix(mix(np.minimum(cid[a], cid[b]).view(_U) + _U(seed)) + np.maximum(cid[a], cid[b]).view(_U))
            for x, y in ((a, b), (b, a)):
                better = (minor[x] == 1) & (h < least[x])
                least[x[better]], mate[x[better]] = h[better], y[better]
        if seed is not None:
            found.append((np.flatnonzero(mate >= 0), mate[mate >= 0]))
        a, b = (np.concatenate(c) for c in zip(*found))
        h = least[a].view(np.int64) if seed is not None else np.zeros(len(a), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(cid[a]), pa.array(cid[b]), pa.array(h)], names=["a", "b", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for batch in _with_end(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                own = [*(batch.column(k).to_numpy() for k in range(9)), batch.column(9).to_pylist()]
                held = own if held is None else [*(np.append(h, c) for h, c in zip(held[:9], own)), held[9] + own[9]]
                other = np.flatnonzero(np.logical_or.reduce([held[k] != held[k][-1] for k in range(3)]))
                end = int(other[-1]) + 1 if len(other) else 0
                if not end:
                    continue  # a unit has a bounded number of rows
            elif held is None:
                return
            else:
                end = len(held[0])
            yield out([c[:end] for c in held])
            held = [c[end:] for c in held] if end < len(held[0]) else None

    return run


def _alike(num: int, den: int):
    """Pairs (a, b, ra, rb, na, nb, sa, sb) that pass the suffix filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_numpy().astype(np.int64) for k in (4, 5))
            most = na + nb - 2 * -(-num * (na + nb) // (num + den))
            ok = []
            for s, t, m in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), most.tolist()):
                k = min(len(s), len(t))
                ok.append(int(np.abs(folded(s, k) - folded(t, k)).sum()) <= m)
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in range(4)], names=["a", "b", "ra", "rb"])

    return run


def _verify(size: int, num: int, den: int):
    """Rows (home, salt, cid, text), each home's own text first: links (u, v) of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, place, s = Hasher(size), None, np.zeros(0, np.uint64)
        for batch in batches:
            u, v = [], []
            homes, cids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for home, cid, t in zip(homes, cids, hasher.sets(*text_buffers(batch.column(3)))):
                if not len(t) or class_of(digest_of(t)) != cid:
                    continue  # another text of a repeated id
                if home == cid:
                    place, s = home, t
                elif home == place:
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    if common and den * common >= num * (len(s) + len(t) - common):
                        u.append(home)
                        v.append(cid)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


@F.arrow_udf(BinaryType())
def _coarse(sketches: pa.Array) -> pa.Array:
    return pa.array([folded(s, COARSE).astype(np.uint16).tobytes() for s in sketches.to_pylist()], pa.binary())


def _apart(members: DataFrame, known: DataFrame) -> tuple[DataFrame, int]:
    """(members of n-grams whose classes are in several components, and about how many pairs of those there are).

    With comp, size (classes of the n-gram), k (those outside its largest component) and minor (being one of them)."""
    sizes = known.groupBy("component").agg(F.count("*").alias("of"))
    # The smallest class of a component is its label and no node of `known`.
    told = known.union(known.select("component", "component").distinct()).toDF("cid", "component").join(sizes, "component")
    labelled = cut(members.join(told, "cid", "left").withColumn("comp", F.coalesce("component", "cid")).fillna(0, ["of"]).drop("component"))
    each = labelled.groupBy("token", "comp").agg(F.count("*").alias("c"), F.first("of").alias("of"))
    largest = F.struct("of", "comp")
    mixed = each.groupBy("token").agg(F.sum("c").alias("size"), F.count("*").alias("comps"), F.max_by("comp", largest).alias("main"), (F.sum("c") - F.max_by("c", largest)).alias("k")).where("comps > 1").drop("comps")
    left = cut(labelled.join(mixed, "token").withColumn("minor", (F.col("comp") != F.col("main")).cast("int")).drop("main", "of"))
    drop(labelled)
    return left, left.agg(F.sum(F.col("minor") * F.col("size"))).first()[0] or 0


def _units(left: DataFrame, classes: DataFrame, window: int, block: int) -> DataFrame:
    """Rows for _across, dealt by unit and in order."""
    columns = ["token", "i", "j", "cid", "n", "pos", "comp", "side", "minor", "coarse"]
    zero = F.lit(0)
    small = left.where(F.col("size") <= window).withColumns({"i": zero, "j": zero, "side": zero, "coarse": F.lit(None).cast("binary")})
    big = left.where(F.col("size") > window).withColumns({"mb": F.ceil((F.col("size") - F.col("k")) / block).cast("int"), "kb": F.ceil(F.col("k") / block).cast("int")})
    # Blocks 0 to mb - 1 are of the largest component, the others follow; a unit is a pair of blocks i <= j.
    big = big.withColumn("side", F.when(F.col("minor") == 0, F.pmod(F.xxhash64("cid"), F.col("mb"))).otherwise(F.col("mb") + F.pmod(F.xxhash64("cid"), F.col("kb"))).cast("int"))
    unit = lambda x: F.struct(F.least(F.col("side"), x).alias("i"), F.greatest(F.col("side"), x).alias("j"))
    others = F.transform(F.sequence("mb", F.col("mb") + F.col("kb") - 1), unit)  # every block meets those of the other components
    firsts = F.when(F.col("minor") == 0, F.array().cast("array<struct<i:int,j:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.col("mb") - 1), unit))
    dealt = big.withColumn("u", F.explode(F.concat(others, firsts))).withColumns({"i": F.col("u.i"), "j": F.col("u.j")})
    large = dealt.join(classes.select("cid", _coarse("sketch").alias("coarse")), "cid")
    return small.select(*columns).union(large.select(*columns)).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "n", "cid")


def similar_components(documents: DataFrame, num: int = 90, den: int = 100, size: int = 3, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK, many: int = MANY) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; two rows link at Jaccard similarity num / den or more."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scanned = cut(docs.mapInArrow(_scan(size, num, den, None), "doc_id bigint, n int, digest binary, sketch binary, block int, counts binary"))
    rows = scanned.where("block is null").select("doc_id", "n", "digest", "sketch")
    counted = scanned.where("block is not null").select("block", "counts")
    for salt in (F.pmod(F.xxhash64("counts"), F.lit(32)), F.lit(0)):
        counted = counted.repartition("block", salt).mapInArrow(_add_up, "block int, counts binary")
    table = np.zeros((BLOCKS, (1 << BITS) // BLOCKS), np.uint32)
    for r in counted.collect():  # 2^20 counts
        table[r["block"]] += np.frombuffer(zlib.decompress(bytes(r["counts"])), np.uint32)
    counts = spark.sparkContext.broadcast(table.tobytes())

    cid = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long").alias("cid")
    classes = cut(rows.where("n > 0 and doc_id is not null").groupBy(cid).agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    prefixes = docs.where("doc_id is not null").select("text").mapInArrow(_scan(size, num, den, counts), PREFIX)
    met = cut(prefixes.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "cid", "pos").mapInArrow(_meet(num, den, window), MET))
    members = met.where("a is null").select("token", "cid", "n", "pos")

    def alike(pairs: DataFrame) -> DataFrame:
        side = lambda k: needed.select(F.col("cid").alias(k), F.col("rep").alias(f"r{k}"), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
        ids = packed(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct())
        needed = packed(classes.join(few(ids), "cid", "left_semi"))
        told = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb", "sa", "sb")
        return told.mapInArrow(_alike(num, den), "a bigint, b bigint, ra bigint, rb bigint")

    def links(pairs: DataFrame) -> DataFrame:
        """The text of b goes to the place of a, and to one of several places where a has many."""
        many = pairs.groupBy("a").agg(F.ceil(F.count("*") / 512).cast("int").alias("m")).where("m > 1")
        placed = pairs.join(many, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("m", F.lit(1))).cast("int"))
        wanted = packed(placed.select(F.col("rb").alias("doc_id"), F.col("a").alias("home"), "salt", F.col("b").alias("cid")).union(placed.select("ra", "a", "salt", F.col("a").alias("c")).distinct()))
        sent = docs.join(few(wanted), "doc_id").select("home", "salt", "cid", "text").repartition("home", "salt")
        return sent.sortWithinPartitions("home", "salt", F.col("cid") != F.col("home")).mapInArrow(_verify(size, num, den), "u bigint, v bigint")

    # Of the smaller ones that each class has a chance with, the one that most n-grams name.
    named = met.where("a is not null").groupBy("a", "b").agg(F.count("*").alias("k")).groupBy("b").agg(F.max_by("a", F.struct("k", "a")).alias("a"))
    tried = packed(named.select("a", "b"))
    known, before = components(links(packed(alike(tried)))), None
    for seed in range(1, ROUNDS + 2):
        left, pairs_left = _apart(members, known)
        if not pairs_left:
            break
        last = seed > ROUNDS or pairs_left <= many * members.count() or (before is not None and 3 * pairs_left > 2 * before)
        before = pairs_left
        found = _units(left, classes, window, block).mapInArrow(_across(num, den, None if last else seed), "a bigint, b bigint, h bigint")
        if last:
            pairs = found.select("a", "b").distinct()
        else:
            some = F.slice(F.array_sort(F.collect_set(F.struct("h", "b"))), 1, TRIES)
            pairs = found.groupBy("a").agg(some.alias("p")).select("a", F.explode("p.b").alias("b"))
        both = tried.union(tried.select("b", "a"))
        new = packed(pairs.join(both, ["a", "b"], "left_anti"))
        drop(left)
        if not new.isEmpty():
            known = components(links(packed(alike(new))).union(known.select("node", "component")))
            tried = tried.union(new)
        if last:
            break
    drop(met)
    label = classes.join(known.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "rep", F.coalesce("component", "cid").alias("comp"))
    least = label.groupBy("comp").agg(F.min("rep").alias("component"))
    place = label.join(least, "comp").select("cid", "component")
    return rows.select("doc_id", "n", cid).join(place, "cid", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )


def one_of_each(documents: DataFrame, num: int = 80, den: int = 100, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component, the rows of its smallest doc_id.

    Rows that repeat an id and its text are one document and all go or stay; rows without an id, a text or a word stay."""
    found = similar_components(documents, num, den, size, doc_id, text)
    name = free_name(documents, "__gone")
    gone = cut(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    return documents.join(few(gone), F.col(doc_id).cast("long") == F.col(name), "left_anti")
