"""Results that are computed once and kept where all executors can read them, and places in an order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on one machine, where it is unset, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kept-"))
    return sc.getCheckpointDir()


def keep(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared folder as compressed columns and read from there; for rows that hold texts."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_position(rows: DataFrame, group: list[str], order: list[str], name: str = "position") -> DataFrame:
    """`rows` with their number within the group, from 0, in the given order (which must be of distinct rows).

    Rows are dealt out by range and numbered in their task; a task's first number is the sum of the counts before it.  No
    task holds a group; the window is over one row for each task that has some of the group."""
    dealt = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = stored(dealt.withColumns({"__task": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))
    counts = placed.groupBy(*group, "__task").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "__task", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    if not group:
        counts = F.broadcast(counts)  # a row for each task
    numbered = placed.join(counts, [*group, "__task"]).withColumn(name, F.col("__before") + F.col("__row") - F.col("__first"))
    return numbered.select(*rows.columns, name)


def with_running(rows: DataFrame, group: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """`rows` with the sum of `amount` over the rows of the group before it, in the given order (of distinct rows).

    Rows are dealt out by range, so a group of any size is shared by many tasks; each part starts at the sum of those before
    it, which a window over one row a task and group gives."""
    placed = keep(rows.repartitionByRange(*group, *order).withColumn("__task", F.spark_partition_id()))
    sums = placed.groupBy(*group, "__task").agg(F.sum(amount).alias("__sum"))
    key = group or [F.lit(0)]
    earlier = Window.partitionBy(*key).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__task").alias("__t"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    same = F.col("__task") == F.col("__t")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    own = Window.partitionBy(*group, "__task").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumn("__own", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    return within.join(start, same).withColumn(name, F.col("__before") + F.col("__own")).select(*rows.columns, name)
