"""Notes tied to code: salience, recall, feedback, staleness, archive.  State in, state out; `now` is given.

A note table has: id, repo_id (null: global), kind, content, salience, status, superseded_by, created_at,
last_access, access_count, helpful_count, noise_count, stale_at, helpful_at, reverified_at, contradicted_at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.keeping import keep, with_position
from .search import closest, nearest, top

DAY = 86_400.0
EARLIER_BLOCK = 8192  # notes of a batch that meet another block in one task


def embed_text(kind: Column, content: Column) -> Column:
    return F.concat(F.lit("memory > "), kind, F.lit("\n"), content)


def valid(kind: Column, source: Column) -> Column:
    return kind.isin(K.KINDS) & source.isin(K.SOURCES)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def salience(surprise: Column, cost: Column, pain: Column) -> Column:
    """From surprise in 0..1 and cost and pain in 0..10 (null: 0, and the default weight)."""
    own = K.SURPRISE_WEIGHT * surprise + K.COST_WEIGHT * clamp(F.coalesce(cost / 10, F.lit(0.0)), 0, 1) + K.EXPLICIT_WEIGHT * clamp(F.coalesce(pain / 10, F.lit(K.EXPLICIT_DEFAULT)), 0, 1)
    return clamp(own, K.SALIENCE_LEAST, 1.0)


def utility(helpful: Column, access: Column) -> Column:
    return 1 + 0.5 * helpful / F.greatest(access, F.lit(1))


def query_score(sim: Column, salience: Column, helpful: Column, access: Column, stale: Column) -> Column:
    return sim * (0.8 + 0.2 * salience) * utility(helpful, access) * F.when(stale, K.STALE_FACTOR).otherwise(1.0)


def recall_score(sim: Column, salience: Column, age_days: Column, helpful: Column, access: Column, stale: Column, half_life: float = K.HALF_LIFE_DAYS) -> Column:
    fade = 0.3 + 0.7 * F.exp(-F.log(F.lit(2.0)) * age_days / max(half_life, 0.1))
    return sim * (0.2 + 0.8 * salience) * fade * utility(helpful, access) * F.when(stale, K.STALE_FACTOR).otherwise(1.0)


def surprises(new: DataFrame, vectors: DataFrame) -> DataFrame:
    """note_id, surprise of a batch (note_id, seq, embedding): 1 less the best similarity to any stored vector
    or to an earlier one of the batch."""
    old = nearest(new.select(F.col("note_id").alias("query_id"), "embedding"), vectors.select(F.col("note_id").alias("chunk_id"), "embedding"), 1)
    near = new.select("note_id").join(old.select(F.col("query_id").alias("note_id"), "distance"), "note_id", "left").join(nearest_earlier(new), "note_id", "left")
    return near.select("note_id", clamp(F.coalesce(F.least("distance", "d"), F.lit(1.0)), 0, 2).alias("surprise"))


def nearest_earlier(new: DataFrame, block: int = EARLIER_BLOCK) -> DataFrame:
    """note_id, d: the least cosine distance to a vector of a smaller seq in the batch; no row for the first ones.

    The batch is cut into blocks in the order of seq, and blocks meet in the triangle of earlier against later ones, a cell a task."""
    own = with_position(new.where("embedding is not null").select("seq", "note_id", "embedding"), [], ["seq", "note_id"])
    n = own.count()
    own = own.withColumn("block", F.floor(F.col("position") / block).cast("int"))
    last = max(0, -(-n // block) - 1)
    row = lambda low, high, name: F.explode(F.sequence(low, high)).alias(name)
    later = own.select("note_id", "seq", "embedding", F.col("block").alias("late"), row(F.lit(0), F.col("block"), "early"))
    earlier = own.select(F.col("note_id").alias("other"), F.col("seq").alias("before"), F.col("embedding").alias("vector"), F.col("block").alias("early"), row(F.col("block"), F.lit(last), "late"))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["note_id", "d"]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        rows = [(x.column(0).to_numpy(), np.asarray(x.column(e).combine_chunks().flatten(), np.float64).reshape(x.num_rows, -1), x.column(1).to_numpy()) for x, e in ((a, "embedding"), (b, "vector"))]
        (ids, v, s), (own, w, t) = rows
        met, _, d = closest((ids, v, np.full(len(ids), None)), (own, w, np.full(len(own), None)), 1, order=(s, t))
        return pa.table([pa.array(ids[met], pa.int64()), pa.array(d)], names=names)

    cells = later.groupBy("late", "early").cogroup(earlier.groupBy("late", "early")).applyInArrow(cell, "note_id long, d double")
    return cells.groupBy("note_id").agg(F.min("d").alias("d"))


def resolve_anchors(anchors: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchors with the hash of their file now, anchors without an indexed file)."""
    met = anchors.join(files.select("repo_id", "relpath", "hash"), ["repo_id", "relpath"], "left")
    return met.where("hash is not null"), met.where("hash is null").drop("hash")


def candidates(queries: DataFrame, vectors: DataFrame, notes: DataFrame, suppressions: DataFrame, k: int = K.NOTE_CANDIDATES) -> DataFrame:
    """query_id, note_id, distance: k of the query's own scope and k global ones, cut to k together, and only
    then without archived, superseded and suppressed notes.

    queries: query_id, embedding, scope_kind (unscoped, repo, unseen), scope_repo_id; vectors: note_id, part
    (0: global), embedding."""
    own = nearest(queries.where("scope_kind = 'repo'").select("query_id", "embedding", F.col("scope_repo_id").alias("scope")), vectors.where("part <> 0").select(F.col("note_id").alias("chunk_id"), "embedding", F.col("part").alias("scope")), k, scoped=True)
    shared = nearest(queries.select("query_id", "embedding"), vectors.where("part = 0").select(F.col("note_id").alias("chunk_id"), "embedding"), k)
    both = top(own.unionByName(shared), ["query_id"], ["distance", "chunk_id"], k).select("query_id", F.col("chunk_id").alias("note_id"), "distance")
    live = both.join(notes.where("status <> 'archived' and superseded_by is null").select(F.col("id").alias("note_id")), "note_id", "left_semi")
    votes = queries.where("scope_kind <> 'unseen'").select("query_id", F.when(F.col("scope_kind") == "repo", F.col("scope_repo_id")).otherwise(F.lit(0)).alias("repo_id"))
    mute = suppressions.join(votes, "repo_id").select("query_id", "note_id")
    return live.join(mute, ["query_id", "note_id"], "left_anti")


def recall(queries: DataFrame, vectors: DataFrame, notes: DataFrame, suppressions: DataFrame, limit: int = 5, least: float = 0.0) -> DataFrame:
    """query_id, note_id, score, rank."""
    found = candidates(queries, vectors, notes, suppressions).join(notes.withColumnRenamed("id", "note_id"), "note_id")
    scored = found.withColumn("score", query_score(1 - F.col("distance"), F.col("salience"), F.col("helpful_count"), F.col("access_count"), F.col("status") == "stale")).where(F.col("score") >= least)
    return top(scored, ["query_id"], [F.desc("score"), "note_id"], max(limit, 1)).select("query_id", "note_id", "score", "rank")


def touch(notes: DataFrame, returned: DataFrame, now: int) -> DataFrame:
    """access_count of the returned notes goes up by the times they were returned."""
    n = returned.groupBy(F.col("note_id").alias("id")).agg(F.count("*").alias("n"))
    return notes.join(n, "id", "left").withColumn("access_count", F.col("access_count") + F.coalesce("n", F.lit(0))).select(*notes.columns)


def cap_globals(scored: DataFrame, keys: list[str], order: list, most: int = K.BRIEF_GLOBALS_MAX) -> DataFrame:
    """Rows in order, of the global ones only the first `most`."""
    n = F.sum(F.col("is_global").cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return scored.withColumn("__n", n).where(~F.col("is_global") | (F.col("__n") <= most)).drop("__n")


def brief(scopes: DataFrame, notes: DataFrame, suppressions: DataFrame, now: int, limit: int = 8, stale_days: int = 7) -> DataFrame:
    """scope_id, part (live, stale), note_id, rank: what a session starts with, for scopes (scope_id, repo_id)."""
    own = notes.withColumnRenamed("id", "note_id").where("superseded_by is null")
    seen = own.join(F.broadcast(scopes.select("scope_id", F.col("repo_id").alias("at"))), F.col("repo_id").isNull() | (F.col("repo_id") == F.col("at")))
    mute = suppressions.select(F.col("repo_id").alias("at"), "note_id")
    seen = seen.join(mute, ["at", "note_id"], "left_anti").withColumn("is_global", F.col("repo_id").isNull())
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.col("last_access")) / DAY)
    live = seen.where("status = 'live'").withColumn("score", recall_score(F.lit(1.0), F.col("salience"), age, F.col("helpful_count"), F.col("access_count"), F.lit(False)))
    live = top(cap_globals(live, ["scope_id"], [F.desc("score"), "note_id"]), ["scope_id"], [F.desc("score"), "note_id"], limit)
    stale = top(seen.where((F.col("status") == "stale") & (F.col("stale_at") >= now - stale_days * 86_400)), ["scope_id"], [F.desc("stale_at"), "note_id"], K.BRIEF_STALE_MAX)
    pick = lambda df, part: df.select("scope_id", F.lit(part).alias("part"), "note_id", "rank")
    return pick(live, "live").unionByName(pick(stale, "stale"))


def apply_votes(notes: DataFrame, suppressions: DataFrame, votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """votes: seq, ts, note_id, helpful, repo_id (0: unscoped).  Helpful votes count, date and lift the scope's
    suppression; noise votes fade the salience and suppress in the scope.  The last vote of a scope decides."""
    per = votes.groupBy(F.col("note_id").alias("id")).agg(F.count_if("helpful").alias("h"), F.count_if(~F.col("helpful")).alias("n"), F.max(F.when(F.col("helpful"), F.col("ts"))).alias("at"))
    n, h = F.coalesce("n", F.lit(0)), F.coalesce("h", F.lit(0))
    after = notes.join(per, "id", "left").withColumns({
        "salience": F.col("salience") * F.pow(F.lit(K.NOISE_DECAY), n), "noise_count": F.col("noise_count") + n, "helpful_count": F.col("helpful_count") + h,
        "last_access": F.coalesce("at", "last_access"), "helpful_at": F.coalesce("at", "helpful_at"),
    }).select(*notes.columns)
    last = votes.groupBy("note_id", "repo_id").agg(F.max_by("helpful", "seq").alias("lifted"), F.min(F.when(~F.col("helpful"), F.col("ts"))).alias("ts"))
    kept = suppressions.join(last, ["note_id", "repo_id"], "left_anti")
    still = suppressions.join(last.where("not lifted"), ["note_id", "repo_id"], "left_semi")
    new = last.where("not lifted").join(suppressions, ["note_id", "repo_id"], "left_anti").select("note_id", "repo_id", F.col("ts").alias("created_at"))
    return after, kept.unionByName(still).unionByName(new.select(*suppressions.columns))


def supersede(notes: DataFrame, commands: DataFrame, at_once: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """commands: seq, old_id, new_id, as if done one by one in the order of seq (distinct; without it, of the ids): a
    command acts if both notes exist, differ and neither is superseded by then; (notes, links).

    What undoes a command is an earlier one that supersedes one of its notes.  So in each round a command with no earlier
    undecided one on either of its notes is settled: it acts, unless one that acted before is in its way.  Rounds take
    as many as the longest chain of such commands; the last `at_once` commands are decided by one task, in order."""
    free = notes.where("superseded_by is null").select("id")
    if "seq" not in commands.columns:
        commands = with_position(commands.select("old_id", "new_id").distinct(), [], ["old_id", "new_id"], "seq")
    left = commands.select("seq", "old_id", "new_id").where("old_id <> new_id")
    left = keep(left.join(free.withColumnRenamed("id", "old_id"), "old_id", "left_semi").join(free.withColumnRenamed("id", "new_id"), "new_id", "left_semi"))
    acted = left.limit(0)
    while (n := left.count()) > at_once:
        first = left.groupBy("old_id").agg(F.min("seq").alias("first"))
        done = acted.select(F.col("old_id").alias("id"), F.col("seq").alias("done"))
        said = left
        for of in ("old", "new"):
            said = said.join(first.select(F.col("old_id").alias(f"{of}_id"), F.col("first").alias(f"first_{of}")), f"{of}_id", "left")
            said = said.join(done.select(F.col("id").alias(f"{of}_id"), F.col("done").alias(f"done_{of}")), f"{of}_id", "left")
        before = lambda c: F.coalesce(F.col(c) < F.col("seq"), F.lit(False))
        undone = before("done_old") | before("done_new")
        state = F.when(undone, "void").when(before("first_old") | before("first_new"), "open").otherwise("acts")
        told = keep(said.select("seq", "old_id", "new_id", state.alias("state")))
        acted = keep(acted.unionByName(told.where("state = 'acts'").drop("state")))
        left = told.where("state = 'open'").drop("state")
    if n:
        # A few: those that acted on their notes and these, in order.
        ids = left.select(F.col("old_id").alias("id")).unionByName(left.select(F.col("new_id").alias("id"))).distinct()
        known = acted.join(ids.withColumnRenamed("id", "old_id"), "old_id", "left_semi").withColumn("acts", F.lit(True))
        last = known.unionByName(left.withColumn("acts", F.lit(False))).groupBy().applyInPandas(_in_order, "seq long, old_id long, new_id long")
        acted = acted.unionByName(last)
    after = notes.join(acted.select(F.col("old_id").alias("id"), "new_id"), "id", "left").withColumn("superseded_by", F.coalesce("superseded_by", "new_id")).select(*notes.columns)
    return after, acted.select(F.col("new_id").alias("note_id"), F.col("old_id").alias("related_id"), F.lit("supersedes").alias("relation"))


def _in_order(rows):
    """Of commands in order, those that act and are not known yet."""
    gone, out = set(), []
    for k in rows.sort_values("seq").itertuples(index=False):
        if k.acts:
            gone.add(k.old_id)
        elif k.old_id not in gone and k.new_id not in gone:
            gone.add(k.old_id)
            out.append((k.seq, k.old_id, k.new_id))
    return rows.iloc[:0][["seq", "old_id", "new_id"]] if not out else type(rows)(out, columns=["seq", "old_id", "new_id"])


def mark_stale(notes: DataFrame, drifted: DataFrame, now: int) -> DataFrame:
    """Notes with a drifted anchor (note_id) are stale from now; archived ones stay."""
    hit = drifted.select(F.col("note_id").alias("id")).distinct().withColumn("__d", F.lit(True))
    due = F.coalesce("__d", F.lit(False)) & (F.col("status") != "archived")
    return notes.join(hit, "id", "left").withColumns({"status": F.when(due, "stale").otherwise(F.col("status")), "stale_at": F.when(due, F.lit(now)).otherwise(F.col("stale_at"))}).select(*notes.columns)


def commit_staleness(notes: DataFrame, anchors: DataFrame, committed: DataFrame, now: int) -> DataFrame:
    """The notes after files (repo_id, relpath, hash) were stored: those with an anchor to another hash of one are
    stale.  Files that were deleted are not among them and make nothing stale."""
    from .ingest import stale_anchors

    return mark_stale(notes, stale_anchors(anchors, committed), now)


def suppression_scopes(suppressions: DataFrame) -> DataFrame:
    """note_id, scopes: the repositories in which a note is muted, without votes from outside of any (0)."""
    return suppressions.where("repo_id <> 0").groupBy("note_id").agg(F.array_sort(F.collect_set("repo_id")).alias("scopes"))


def stale_list(notes: DataFrame, anchors: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Stale notes with all the paths they are tied to; with `paths`, those tied to one of them."""
    tied = anchors.groupBy(F.col("note_id").alias("id")).agg(F.array_sort(F.collect_set("relpath")).alias("paths"))
    rows = notes.where("status = 'stale' and superseded_by is null").join(tied, "id", "left")
    if paths is not None:
        rows = rows.where(F.arrays_overlap("paths", F.array(*map(F.lit, paths))))
    return rows.orderBy(F.desc("stale_at"), "id")


def reverifiable(notes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Stale notes with anchors that were not checked since they became stale, oldest first."""
    due = notes.where("status = 'stale' and superseded_by is null and (reverified_at is null or reverified_at < stale_at)")
    return due.join(anchors.select(F.col("note_id").alias("id")).distinct(), "id", "left_semi").orderBy("stale_at", "id")


def render_evidence(cited: DataFrame, most: int = K.EVIDENCE_BYTES) -> DataFrame:
    """note_id, evidence, cited: blocks `path:a-b` and text, in order, until the bytes are full.

    cited: note_id, seq, relpath, start_line, end_line, content."""
    from ..functions.hashing import truncate_utf8

    label = F.format_string("%s:%d-%d", "relpath", "start_line", "end_line")
    rows = cited.withColumn("label", label).withColumn("block", F.concat("label", F.lit("\n"), "content"))
    before = F.coalesce(F.sum(F.octet_length("block") + 2).over(Window.partitionBy("note_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = rows.withColumn("before", before).where(F.col("before") < most)
    listed = used.groupBy("note_id").agg(F.array_sort(F.collect_list(F.struct("seq", "label", "block"))).alias("b"))
    join = lambda f, by: F.array_join(F.transform("b", lambda x: x[f]), by)
    return listed.select("note_id", truncate_utf8(most)(join("block", "\n\n")).alias("evidence"), join("label", ", ").alias("cited"))


def verdict(holds: Column, contradiction: Column) -> Column:
    """From the two scores; the second is only asked for where the first fails, so it may be null."""
    return F.when(holds >= K.THRESHOLDS["holds"], "holds").when(contradiction >= K.THRESHOLDS["contradiction"], "contradicted").otherwise("inconclusive")


def commit_verdicts(notes: DataFrame, verdicts: DataFrame, now: int) -> DataFrame:
    """verdicts: note_id, verdict.  Holds: live again; contradicted and inconclusive are dated."""
    v = notes.join(verdicts.select(F.col("note_id").alias("id"), "verdict"), "id", "left")
    holds, against, any_ = F.col("verdict") == "holds", F.col("verdict") == "contradicted", F.col("verdict").isin("contradicted", "inconclusive")
    return v.withColumns({
        "status": F.when(holds, "live").otherwise(F.col("status")), "stale_at": F.when(holds, None).otherwise(F.col("stale_at")),
        "reverified_at": F.when(any_, F.lit(now)).otherwise(F.col("reverified_at")), "contradicted_at": F.when(against, F.lit(now)).otherwise(F.col("contradicted_at")),
    }).select(*notes.columns)


def gc_rule(now: int, half_life: float = K.HALF_LIFE_DAYS, stale_days: int = K.STALE_DAYS, floor: float = K.EPISODE_FLOOR) -> Column:
    """The first rule that archives a note, or null; the row has `own_noise` and `noise_scopes` of its votes."""
    is_stale = (F.col("status") == "stale") & F.col("stale_at").isNotNull() & ~F.coalesce(F.col("helpful_at") >= F.col("stale_at"), F.lit(False))
    checked = F.coalesce(F.col("reverified_at") >= F.col("stale_at"), F.lit(False))
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.col("last_access")) / DAY)
    faded = recall_score(F.lit(1.0), F.col("salience"), age, F.col("helpful_count"), F.col("access_count"), F.col("status") == "stale", half_life)
    noisy = (F.col("helpful_count") == 0) & F.when(F.col("repo_id").isNotNull(), F.col("own_noise") > 0).otherwise(F.col("noise_scopes") >= K.GLOBAL_NOISE_SCOPES)
    return (
        F.when(F.col("status") == "archived", None).when(F.col("superseded_by").isNotNull(), "superseded")
        .when(is_stale & F.coalesce(F.col("contradicted_at") >= F.col("stale_at"), F.lit(False)), "contradicted")
        .when(is_stale & ~checked & (F.col("stale_at") < now - stale_days * 86_400), "stale")
        .when((F.col("kind") == "episode") & (F.col("helpful_count") == 0) & (faded < floor), "episode").when(noisy, "noise")
    )


def gc(notes: DataFrame, suppressions: DataFrame, now: int, dry_run: bool = False, **rules) -> tuple[DataFrame, DataFrame]:
    """(notes with matching ones archived, count by rule)."""
    votes = suppressions.where("repo_id <> 0").join(notes.select(F.col("id").alias("note_id"), F.col("repo_id").alias("home")), "note_id")
    noise = votes.groupBy(F.col("note_id").alias("id")).agg(F.count_if(F.col("repo_id") == F.col("home")).alias("own_noise"), F.count_distinct("repo_id").alias("noise_scopes"))
    ruled = notes.join(noise, "id", "left").fillna(0, ["own_noise", "noise_scopes"]).withColumn("rule", gc_rule(now, **rules))
    counts = ruled.where("rule is not null").groupBy("rule").agg(F.count("*").alias("n"))
    after = notes if dry_run else ruled.withColumn("status", F.when(F.col("rule").isNotNull(), "archived").otherwise(F.col("status"))).select(*notes.columns)
    return after, counts


def drop_vectors(vectors: DataFrame, notes: DataFrame) -> DataFrame:
    """Archived and superseded notes have no vector."""
    return vectors.join(notes.where("status = 'archived' or superseded_by is not null").select(F.col("id").alias("note_id")), "note_id", "left_anti")


def restore(notes: DataFrame, ids: DataFrame, drifted: DataFrame, suppressions: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Archived notes (ids: id) come back: stale if they were or an anchor drifted, salience unfaded, votes of
    noise and suppressions cleared."""
    back = notes.where("status = 'archived' and superseded_by is null").join(ids.select("id").distinct(), "id", "left_semi").select("id").withColumn("__b", F.lit(True))
    moved = drifted.select(F.col("note_id").alias("id")).distinct().withColumn("__d", F.lit(True))
    j = notes.join(back, "id", "left").join(moved, "id", "left")
    b = F.coalesce("__b", F.lit(False))
    state = F.when(F.coalesce("__d", F.lit(False)) | F.col("stale_at").isNotNull(), "stale").otherwise("live")
    after = j.withColumns({
        "status": F.when(b, state).otherwise(F.col("status")), "salience": F.when(b, F.least(F.lit(1.0), F.col("salience") / F.pow(F.lit(K.NOISE_DECAY), F.col("noise_count")))).otherwise(F.col("salience")),
        "stale_at": F.when(b & F.coalesce("__d", F.lit(False)) & F.col("stale_at").isNull(), F.lit(now)).otherwise(F.col("stale_at")),
        "noise_count": F.when(b, 0).otherwise(F.col("noise_count")), "last_access": F.when(b, F.lit(now)).otherwise(F.col("last_access")),
    }).select(*notes.columns)
    return after, suppressions.join(back.select(F.col("id").alias("note_id")), "note_id", "left_anti")


def reaffirm(notes: DataFrame, anchors: DataFrame, commands: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """commands: note_id, evidence.  Stale notes whose anchored files are all indexed are live again, with
    their anchors' hashes of now."""
    met = anchors.join(files.select("repo_id", "relpath", F.col("hash").alias("now_hash")), ["repo_id", "relpath"], "left")
    broken = met.where("now_hash is null").select("note_id").distinct()
    ok = commands.join(broken, "note_id", "left_anti").join(notes.where("status = 'stale' and superseded_by is null").select(F.col("id").alias("note_id")), "note_id", "left_semi")
    mark = ok.select(F.col("note_id").alias("id")).distinct().withColumn("__ok", F.lit(True))
    done = F.coalesce("__ok", F.lit(False))
    after = notes.join(mark, "id", "left").withColumns({"status": F.when(done, "live").otherwise(F.col("status")), "stale_at": F.when(done, None).otherwise(F.col("stale_at"))}).select(*notes.columns)
    fresh = met.join(mark.withColumnRenamed("id", "note_id"), "note_id", "left").withColumn("hash", F.when(F.col("__ok"), F.col("now_hash")).otherwise(F.col("hash")))
    return after, fresh.select(*anchors.columns)


def prune(notes: DataFrame, suppressions: DataFrame, repo_id: int, target: int | None) -> DataFrame:
    """Notes of a repository that goes: to the target, or else archived if muted and never helpful and global if not."""
    muted = suppressions.where(F.col("repo_id") == repo_id).select(F.col("note_id").alias("id")).distinct().withColumn("__m", F.lit(True))
    mine = F.coalesce(F.col("repo_id") == repo_id, F.lit(False))
    if target is not None:
        return notes.withColumn("repo_id", F.when(mine, F.lit(target)).otherwise(F.col("repo_id")))
    j = notes.join(muted, "id", "left")
    archive = mine & F.coalesce("__m", F.lit(False)) & (F.col("helpful_count") == 0)
    return j.withColumns({"status": F.when(archive, "archived").otherwise(F.col("status")), "repo_id": F.when(mine, None).otherwise(F.col("repo_id"))}).select(*notes.columns)


def prune_tied(notes: DataFrame, vectors: DataFrame, suppressions: DataFrame, anchors: DataFrame, repo_id: int, target: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors, suppressions, anchors) of a repository that goes; `notes` are those after `prune`.

    With a target they go there, where a suppression that the target has already is not repeated.  Without one vectors
    become global and its anchors and suppressions go.  Archived notes lose their vectors."""
    live = drop_vectors(vectors, notes)
    mine = F.col("repo_id") == repo_id
    moved = live.withColumn("part", F.when(F.col("part") == repo_id, F.lit(target or 0).cast("long")).otherwise(F.col("part")))
    if target is None:
        return moved, suppressions.where(~mine), anchors.where(~mine)
    had = suppressions.where(F.col("repo_id") == target).select("note_id")
    taken = suppressions.where(mine).join(had, "note_id", "left_anti").withColumn("repo_id", F.lit(target).cast("long"))
    goes = F.when(mine, F.lit(target)).otherwise(F.col("repo_id")).cast("long")
    return moved, suppressions.where(~mine).unionByName(taken.select(*suppressions.columns)), anchors.withColumn("repo_id", goes)


def source_stats(notes: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    return notes.groupBy("source").agg(
        F.count("*").alias("total"), n(F.col("status") == "live").alias("live"), n(F.col("status") == "stale").alias("stale"), n(F.col("status") == "archived").alias("archived"),
        n(F.col("superseded_by").isNotNull()).alias("superseded"), F.sum("helpful_count").alias("helpful"), F.sum("noise_count").alias("noise"),
    ).where("total > 0")


def counts(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "live").alias("live"), F.count_if(F.col("status") == "stale").alias("stale"), F.count_if(F.col("status") == "archived").alias("archived"))


def remember(notes: DataFrame, vectors: DataFrame, anchors: DataFrame, commands: DataFrame, files: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(notes, vectors, anchors, rejected) after commands: seq, repo_id, kind, content, pain, cost, source,
    embedding, anchors array<struct<relpath, start_line, end_line>>.

    A command of an unknown kind or source, or with an anchor whose file is not indexed, is rejected whole."""
    wanted = commands.select("seq", "repo_id", F.posexplode("anchors").alias("at", "a")).select("seq", "repo_id", "at", "a.*")
    met, missing = resolve_anchors(wanted, files)
    fine = commands.where(F.coalesce(valid(F.col("kind"), F.col("source")), F.lit(False))).join(missing.select("seq").distinct(), "seq", "left_anti")
    last = notes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    numbered = fine.withColumn("k", F.row_number().over(Window.orderBy("seq"))).crossJoin(F.broadcast(last)).withColumn("id", F.col("last") + F.col("k"))
    own = surprises(numbered.select(F.col("id").alias("note_id"), "seq", "embedding"), vectors).withColumnRenamed("note_id", "id")
    rows = numbered.join(own, "id").withColumn("salience", salience(F.col("surprise"), F.col("cost"), F.col("pain")))
    zero, never = F.lit(0).cast("long"), F.lit(None).cast("long")
    made = rows.select(
        "id", "repo_id", "kind", "content", "salience", F.lit("live").alias("status"), never.alias("superseded_by"), F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("last_access"), zero.alias("access_count"),
        zero.alias("helpful_count"), zero.alias("noise_count"), "source", never.alias("stale_at"), never.alias("helpful_at"), never.alias("reverified_at"), never.alias("contradicted_at"),
    )
    placed = rows.select(F.col("id").alias("note_id"), F.coalesce("repo_id", F.lit(0)).alias("part"), "embedding")
    tied = met.join(rows.select("seq", F.col("id").alias("note_id")), "seq").select("note_id", F.col("at").alias("seq"), "repo_id", "relpath", "start_line", "end_line", "hash")
    rejected = commands.join(fine.select("seq"), "seq", "left_anti").select("seq", "kind", "source")
    return notes.unionByName(made.select(*notes.columns)), vectors.unionByName(placed.select(*vectors.columns)), anchors.unionByName(tied.select(*anchors.columns)), rejected


def stale_lines(listed: DataFrame) -> DataFrame:
    """id, line: tab-separated id, kind, paths and content of stale notes, escaped."""
    from ..functions.text import escape_field

    paths = F.array_join(F.transform(F.coalesce("paths", F.array().cast("array<string>")), lambda p: escape_field(p, True)), ",")
    return listed.select("id", F.concat_ws("\t", F.col("id").cast("string"), "kind", paths, escape_field(F.col("content"))).alias("line"))
