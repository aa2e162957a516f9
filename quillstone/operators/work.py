"""Work lists: items, state, closing, moving; commands are tables with a sequence number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def status_order(status: Column) -> Column:
    """doing, todo, done, others."""
    out = F.lit(len(K.WORK_STATUSES))
    for i, s in reversed(list(enumerate(K.WORK_STATUSES))):
        out = F.when(status == s, i).otherwise(out)
    return out


def add_items(lists: DataFrame, items: DataFrame, commands: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """commands: seq, repo_id, name, task, status.  Lists are made or opened again; ids go on from the largest."""
    bad = ~F.coalesce("status", F.lit("todo")).isin(K.WORK_STATUSES)
    ok = commands.where(~bad).withColumn("status", F.coalesce("status", F.lit("todo")))
    named = ok.groupBy("repo_id", "name").agg(F.min("seq").alias("seq"))
    met = lists.join(named, ["repo_id", "name"], "full_outer")
    last = lists.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    new = met.where("id is null").withColumn("k", F.row_number().over(Window.orderBy("seq"))).crossJoin(F.broadcast(last)).withColumn("id", F.col("last") + F.col("k"))
    touched = F.col("seq").isNotNull()
    old = met.where("id is not null").withColumns({"closed_at": F.when(touched, None).otherwise(F.col("closed_at")), "updated_at": F.when(touched, F.lit(now)).otherwise(F.col("updated_at"))})
    after = old.select(*lists.columns).unionByName(new.withColumns({"closed_at": F.lit(None).cast("long"), "updated_at": F.lit(now)}).select(*lists.columns))
    top_id = items.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = ok.join(after.select(F.col("id").alias("list_id"), "repo_id", "name"), ["repo_id", "name"]).withColumn("k", F.row_number().over(Window.orderBy("seq"))).crossJoin(F.broadcast(top_id))
    rows = fresh.select((F.col("top") + F.col("k")).alias("id"), "list_id", "task", "status", F.lit(None).cast("string").alias("note"), F.lit(now).cast("long").alias("updated_at"))
    return after, items.unionByName(rows.select(*items.columns))


def update_items(items: DataFrame, lists: DataFrame, commands: DataFrame, now: int) -> DataFrame:
    """commands: seq, repo_id, item_id, status, note; null keeps what is there, and other repositories' items
    are left alone.  Of several commands the last one that says something counts."""
    own = items.select("id", "list_id").join(lists.select(F.col("id").alias("list_id"), "repo_id"), "list_id")
    ok = commands.join(own.select(F.col("id").alias("item_id"), "repo_id"), ["item_id", "repo_id"], "left_semi")
    said = ok.groupBy(F.col("item_id").alias("id")).agg(F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("s"), F.max_by("note", F.when(F.col("note").isNotNull(), F.col("seq"))).alias("n"), F.lit(True).alias("hit"))
    j = items.join(said, "id", "left")
    return j.withColumns({"status": F.coalesce("s", "status"), "note": F.coalesce("n", "note"), "updated_at": F.when(F.col("hit"), F.lit(now)).otherwise(F.col("updated_at"))}).select(*items.columns)


def set_state(state: DataFrame, commands: DataFrame) -> DataFrame:
    """commands: seq, list_id, key, value; the last one counts and a null value deletes."""
    last = commands.groupBy("list_id", "key").agg(F.max_by(F.struct("value"), "seq").alias("v")).select("list_id", "key", "v.value")
    return state.join(last, ["list_id", "key"], "left_anti").unionByName(last.where("value is not null").select(*state.columns))


def close(lists: DataFrame, commands: DataFrame, now: int) -> DataFrame:
    """commands: seq, list_id, open (true opens again); of several for one list the last one counts."""
    said = commands.groupBy(F.col("list_id").alias("id")).agg(F.max_by("open", "seq").alias("open"))
    j = lists.join(said, "id", "left")
    closed = F.when(F.col("open"), None).when(~F.col("open"), F.lit(now)).otherwise(F.col("closed_at"))
    return j.withColumns({"closed_at": closed, "updated_at": F.when(F.col("open").isNotNull(), F.lit(now)).otherwise(F.col("updated_at"))}).select(*lists.columns)


def work_lists(lists: DataFrame, items: DataFrame, state: DataFrame, name: str | None = None, everything: bool = False) -> DataFrame:
    """Lists with their open items (by status, then id) and state (by key), nested, the latest first.

    Closed lists and finished items come with `everything`; a list that is named comes even when it is closed."""
    rows = lists if name is None else lists.where(F.col("name") == name)
    rows = rows if everything or name is not None else rows.where("closed_at is null")
    shown = items if everything else items.where(F.col("status").isin("todo", "doing"))
    own = shown.groupBy(F.col("list_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(status_order(F.col("status")).alias("o"), F.col("id").alias("item_id"), "task", "status", "note"))).alias("items"))
    keys = state.groupBy(F.col("list_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("state"))
    return rows.join(own, "id", "left").join(keys, "id", "left").orderBy(F.desc("updated_at"), F.desc("id"))


def move(lists: DataFrame, items: DataFrame, state: DataFrame, repo_id: int, target: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lists of a repository go to another; one whose name is taken is folded in, where the target's state wins."""
    mine = lists.where(F.col("repo_id") == repo_id)
    there = lists.where(F.col("repo_id") == target).select("name", F.col("id").alias("into"))
    fold = mine.join(there, "name").select("id", "into")
    goes = lambda df: df.join(fold.withColumnRenamed("id", "list_id"), "list_id", "left")
    after = lists.join(fold, "id", "left_anti").withColumn("repo_id", F.when(F.col("repo_id") == repo_id, F.lit(target)).otherwise(F.col("repo_id")))
    own = goes(items).withColumn("list_id", F.coalesce("into", "list_id")).select(*items.columns)
    folded = goes(state).where("into is not null").select(F.col("into").alias("list_id"), "key", "value").join(state.select("list_id", "key"), ["list_id", "key"], "left_anti")
    kept = state.join(fold.select(F.col("id").alias("list_id")), "list_id", "left_anti")
    return after, own, kept.unionByName(folded.select(*state.columns))


def age(seconds: Column) -> Column:
    """`now`, `5m`, `3h`, `2d`."""
    return F.when(seconds < 60, "now").when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"))).when(seconds < 86_400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(seconds / 86_400).cast("string"), F.lit("d")))


def render(nested: DataFrame, now: int) -> DataFrame:
    """id, text: a list's name and age, then a line for each item."""
    item = lambda x: F.concat(F.lit("  ["), x["status"], F.lit("] #"), x["item_id"].cast("string"), F.lit(" "), x["task"], F.coalesce(F.concat(F.lit(" ("), x["note"], F.lit(")")), F.lit("")))
    head = F.concat("name", F.lit(" ("), age(F.lit(now) - F.col("updated_at")), F.lit(")"))
    return nested.select("id", F.array_join(F.concat(F.array(head), F.coalesce(F.transform("items", item), F.array().cast("array<string>"))), "\n").alias("text"))
