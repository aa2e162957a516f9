"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the context's, or the one named in spark.checkpoint.dir.

    On a master of one machine the temporary folder will do; elsewhere there must be a name."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` once in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def drop(done: DataFrame) -> None:
    """Delete what `cut` wrote for `done`, which nothing that is still to be computed may need."""
    sc = done.sparkSession.sparkContext
    file = done._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """`cut(df)` of a narrow table in partitions of about `rows` rows, so that small tables make few tasks and files."""
    own = cut(df)
    return own.coalesce(max(1, -(-own.count() // rows)))


def few(df: DataFrame, most: int = 250_000) -> DataFrame:
    """`df`, a narrow table already materialised, marked for broadcast if it has `most` rows or fewer."""
    return F.broadcast(df) if df.count() <= most else df


def small_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 32) -> None:
    """Bound an Arrow batch of whole texts, in rows and in bytes."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)):
        now = int(str(spark.conf.get(key)).rstrip("bB"))
        if now > most or now <= 0:
            spark.conf.set(key, most)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bind(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Memo(dict):
    """word -> function(word), emptied when it holds `most` words.  Words above LONG bytes are not held, so that
    its memory is bounded."""

    LONG = 64

    def __init__(self, function, most: int = 400_000):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, word):
        value = self.function(word)
        if len(word) <= self.LONG:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value
