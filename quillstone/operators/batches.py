"""Requests of a sync: files in path order, cut greedily by number and by bytes, many tasks to a repository.

A request holds at most `most` files, so where the next one begins depends on that many files only.  A block of files is
therefore a small table: for each place where its first own request may begin (0 to most - 1), how many requests
begin in it and how far the last one reaches into the next block.  Such tables can be put together in any grouping, so
blocks of blocks are summed up level by level, and on the way down each block learns where it begins and how many
requests are before it.  A last level has one block a repository; no task ever holds more than SPAN rows of a level."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.keeping import keep, with_position

SPAN = 4096


def _steps(sizes: np.ndarray, most: int, limit: int) -> np.ndarray:
    """For each file how many files a request takes that begins with it: at least one, however large."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    fit = np.searchsorted(ends, ends[:-1] + limit, side="right") - 1 - np.arange(len(sizes))
    return np.clip(fit, 1, most)


def _leaf(most: int, limit: int):
    """A block's files, and those of the next block that its last request may take -> the block's table."""

    def table(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        n = int((rows.column("own").to_numpy(zero_copy_only=False)).sum())
        steps = _steps(rows.column("size").to_numpy(), most, limit)[:n]
        exits, counts = np.zeros(n + most, np.int64), np.zeros(n + most, np.int64)
        exits[n:] = np.arange(most)
        for i in range(n - 1, -1, -1):
            j = i + steps[i]
            exits[i], counts[i] = exits[j], counts[j] + 1
        return pa.table({"repo_key": [key[0].as_py()], "block": [key[1].as_py()], "exits": [exits[:most].tolist()], "counts": [counts[:most].tolist()]}, schema=_TABLE)

    return table


_TABLE = pa.schema([("repo_key", pa.string()), ("block", pa.int64()), ("exits", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def _together(key: tuple, rows: pa.Table) -> pa.Table:
    """Tables of neighbouring blocks -> the table of them all."""
    rows = rows.sort_by("block")
    at = count = None
    for exits, counts in zip(rows.column("exits").to_pylist(), rows.column("counts").to_pylist()):
        exits, counts = np.array(exits), np.array(counts)
        at, count = (exits, counts) if at is None else (exits[at], count + counts[at])
    return pa.table({"repo_key": [key[0].as_py()], "block": [key[1].as_py()], "exits": [at.tolist()], "counts": [count.tolist()]}, schema=_TABLE)


def _entries(key: tuple, rows: pa.Table) -> pa.Table:
    """Neighbouring blocks with where the first of them begins -> where each begins, and the requests before it."""
    rows = rows.sort_by("block")
    entry, before, out = rows.column("entry")[0].as_py(), rows.column("before")[0].as_py(), []
    for block, exits, counts in zip(rows.column("block").to_pylist(), rows.column("exits").to_pylist(), rows.column("counts").to_pylist()):
        out.append((key[0].as_py(), block, entry, before))
        entry, before = exits[entry], before + counts[entry]
    repo, block, entry, before = zip(*out)
    return pa.table({"repo_key": pa.array(repo, pa.string()), "block": pa.array(block, pa.int64()), "entry": pa.array(entry, pa.int64()), "before": pa.array(before, pa.int64())})


def _number(most: int, limit: int):
    def number(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        n = int((rows.column("own").to_numpy(zero_copy_only=False)).sum())
        steps = _steps(rows.column("size").to_numpy(), most, limit)
        begins, i = np.zeros(n, np.int64), rows.column("entry")[0].as_py()
        while i < n:
            begins[i] = 1
            i += int(steps[i])
        own = rows.slice(0, n)
        batch = rows.column("before")[0].as_py() + np.cumsum(begins) - 1
        return pa.table({"repo_key": own.column("repo_key"), "relpath": own.column("relpath"), "batch": pa.array(batch, pa.int64())})

    return number


def sync_batches(files: DataFrame, most: int = K.BATCH_FILES, limit: int = K.BATCH_BYTES, span: int = SPAN) -> DataFrame:
    """`files` (repo_key, relpath, size, and more; paths are distinct in a repository) with the number of their request.

    In path order, a request is closed when it holds `most` files or when the next file would take it over `limit`
    bytes.  That holds for an empty first request too: if a repository's first file is larger than the limit, request 0
    has no file (but takes the deletes), and the file goes to request 1.  A null size counts as 0."""
    sized = with_position(files.select("repo_key", "relpath", F.coalesce("size", F.lit(0)).cast("long").alias("size")), ["repo_key"], ["relpath"])
    block = F.floor(F.col("position") / span)
    ahead = (F.col("position") % span < most - 1) & (F.col("position") >= span)  # also seen by the block before
    blocks = keep(
        sized.withColumn("block", F.explode(F.when(ahead, F.array(block, block - 1)).otherwise(F.array(block))))
        .withColumn("own", F.col("block") == block)
    )
    last = blocks.agg(F.max("block")).first()[0]
    if last is None:
        return files.withColumn("batch", F.lit(None).cast("long"))
    table_type = "repo_key string, block long, exits array<long>, counts array<long>"
    levels = [keep(blocks.groupBy("repo_key", "block").applyInArrow(_leaf(most, limit), table_type))]
    while last > 0:  # one level for every factor of SPAN in the number of blocks
        last //= span
        own = levels[-1].withColumn("parent", F.floor(F.col("block") / span))
        levels.append(keep(own.groupBy("repo_key", "parent").applyInArrow(_together, table_type)))
    entries = levels[-1].select("repo_key", "block", F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("before"))
    for level in reversed(levels[:-1]):
        parents = entries.withColumnRenamed("block", "parent")
        own = level.withColumn("parent", F.floor(F.col("block") / span)).join(parents, ["repo_key", "parent"])
        entries = own.groupBy("repo_key", "parent").applyInArrow(_entries, "repo_key string, block long, entry long, before long")
    numbered = blocks.join(entries, ["repo_key", "block"]).groupBy("repo_key", "block").applyInArrow(_number(most, limit), "repo_key string, relpath string, batch long")
    large = sized.where((F.col("position") == 0) & (F.col("size") > limit)).select("repo_key", F.lit(1).alias("__more"))
    told = numbered.join(large, "repo_key", "left").select("repo_key", "relpath", (F.col("batch") + F.coalesce("__more", F.lit(0))).alias("batch"))
    return files.join(told, ["repo_key", "relpath"])


def sync_requests(files: DataFrame, deletes: DataFrame) -> DataFrame:
    """repo_key, batch, relpath, action: what each request of a sync holds.  All deletes (repo_key, relpath) of a
    repository go with its first request, also if it has no files to send."""
    upserts = sync_batches(files).select("repo_key", "batch", "relpath", F.lit("upsert").alias("action"))
    return upserts.unionByName(deletes.select("repo_key", F.lit(0).cast("long").alias("batch"), "relpath", F.lit("delete").alias("action")))
