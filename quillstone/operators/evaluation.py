"""Quality of retrieval, of reranking and of a yes/no scorer."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.keeping import with_running


def expectation(expect: Column) -> Column:
    """struct(path, line) of `path` or `path:7`."""
    numbered = expect.rlike(":[0-9]+$")
    return F.struct(F.when(numbered, F.regexp_extract(expect, "^(.*):[0-9]+$", 1)).otherwise(expect).alias("path"), F.when(numbered, F.regexp_extract(expect, ":([0-9]+)$", 1).cast("int")).alias("line"))


def first_ranks(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """case_no, rank: where the first hit (case_no, pos, relpath, start_line, end_line) that is expected stands."""
    want = cases.select("case_no", F.explode("expect").alias("e")).select("case_no", expectation(F.col("e")).alias("w")).select("case_no", "w.*")
    met = hits.join(want, "case_no").where((F.col("relpath") == F.col("path")) & (F.col("line").isNull() | F.col("line").between(F.col("start_line"), F.col("end_line"))))
    return cases.select("case_no").join(met.groupBy("case_no").agg(F.min("pos").alias("rank")), "case_no", "left")


def summarize(ranks: DataFrame, k: int = 10) -> DataFrame:
    """cases, recall within k, mean reciprocal rank."""
    hit = F.col("rank") < k
    return ranks.agg(F.count("*").alias("cases"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("recall"), F.avg(F.when(hit, 1.0 / (F.col("rank") + 1)).otherwise(0.0)).alias("mrr"))


def ranked_values(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """keys, v, times, below, n: each distinct value that is not null, how often it occurs, how many rows have a smaller
    one, and how many rows there are.  No task holds all values of a group."""
    keys = keys or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("v")).agg(F.count("*").alias("times"))
    below = with_running(counts, keys, ["v"], "times", "below")
    n = counts.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.sum("times").alias("n"))
    if not keys:
        return below.crossJoin(F.broadcast(n))  # one row
    return below.join(n, reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])).drop(*[f"__{k}" for k in keys])


def _holds(rank: Column) -> Column:
    return (F.col("below") <= rank) & (rank < F.col("below") + F.col("times"))


def percentile(df: DataFrame, column: str, p: int, keys: list[str] | None = None) -> DataFrame:
    """The value at index (n - 1) * p / 100, rounded down, of the sorted values that are not null, for each of `keys`."""
    return ranked_values(df, column, keys).where(_holds(F.floor((F.col("n") - 1) * p / 100))).select(*(keys or []), F.col("v").alias(f"p{p}"))


def median(df: DataFrame, column: str) -> DataFrame:
    """One row: the exact median, the mean of the two middle values of an even number; null without values."""
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    middle = ranked_values(df, column)
    return middle.agg((F.sum(F.when(_holds(low), F.col("v").cast("double"))) / 2 + F.sum(F.when(_holds(high), F.col("v").cast("double"))) / 2).alias("median"))


def spread(runs: DataFrame, column: str) -> DataFrame:
    return runs.agg(F.min(column).alias("low"), F.max(column).alias("high"))


def auroc(scored: DataFrame) -> DataFrame:
    """auroc of (label, score) by rank sums, ties counting half; null with one class only.

    Counts by distinct score are enough, so equal scores never meet as pairs."""
    by = scored.groupBy("score").agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n"))
    return with_running(by, [], ["score"], "n", "below").agg((F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("n"))) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auroc"))


def calibration(scored: DataFrame, threshold: float) -> DataFrame:
    """False accepts and rejects at a threshold, the worst negative, and the positives above all negatives.
    A row without score counts as rejected."""
    s = F.coalesce("score", F.lit(0.0))
    rows = scored.withColumn("s", s)
    worst = rows.where(~F.col("label")).agg(F.max("s").alias("worst"))
    counts = rows.crossJoin(F.broadcast(worst)).agg(
        F.count_if(~F.col("label") & (F.col("s") >= threshold)).alias("false_accepts"), F.count_if(F.col("label") & (F.col("s") < threshold)).alias("false_rejects"),
        F.max("worst").alias("worst_negative"), F.count_if(F.col("label") & (F.col("s") <= F.coalesce("worst", F.lit(-1.0)))).alias("lost_above_worst"),
    )
    return median(rows, "s").crossJoin(F.broadcast(counts))  # one row each


def yes_probability(top: Column, yes: str = "yes", no: str = "no") -> Column:
    """P(yes) of a first token's alternatives (token, logprob): the share of yes among yes and no; null if neither."""
    mass = lambda word: F.aggregate(F.filter(top, lambda t: F.lower(F.trim(t["token"])) == word), F.lit(0.0), lambda a, t: a + F.exp(t["logprob"]))
    return mass(yes) / F.nullif(mass(yes) + mass(no), F.lit(0.0))


def text_probability(reply: Column) -> Column:
    """Of a reply in words, where no alternatives are given."""
    word = F.lower(F.regexp_extract(reply, r"^\s*([A-Za-z]+)", 1))
    return F.when(word == "yes", 1.0).when(word == "no", 0.0)


def ann_recall(exact: DataFrame, coarse: DataFrame, k: int, tolerance: float = 1e-6) -> DataFrame:
    """query_id, recall: the share of coarse hits no farther than the k-th exact one."""
    edge = exact.where(F.col("rank") < k).groupBy("query_id").agg(F.max("distance").alias("edge"), F.count("*").alias("n"))
    hits = coarse.where(F.col("rank") < k).join(edge, "query_id").groupBy("query_id", "n").agg(F.count_if(F.col("distance") <= F.col("edge") + tolerance).alias("hits"))
    return hits.select("query_id", (F.col("hits") / F.col("n")).alias("recall"))


def rerank_simulation(candidates: DataFrame, grid: DataFrame) -> DataFrame:
    """mode, weight, top_n, recall, mrr over cases (case_no, pos, rerank_rank, expected) and a grid of settings.

    The reranker's ranks count within the first top_n of the pool (null: all).  Modes: fused keeps the pool's
    order; replace has what is reranked in the reranker's order, then the pool beyond top_n; rrf adds both
    reciprocal ranks."""
    rows = candidates.join(F.broadcast(grid))  # a few settings
    keys = ["mode", "weight", "top_n", "case_no"]
    inside = F.col("top_n").isNull() | (F.col("pos") < F.col("top_n"))
    ranked = F.col("rerank_rank").isNotNull() & inside
    again = F.when(ranked, F.sum(ranked.cast("int")).over(Window.partitionBy(*keys).orderBy(F.col("rerank_rank").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("again", F.coalesce(again, F.when(ranked, F.lit(0)))).where((F.col("mode") != "replace") | ranked | ~inside)
    own = 1.0 / (K.RRF_K + 1 + F.col("pos"))
    both = own + F.coalesce(F.col("weight") / (K.RRF_K + 1 + F.col("again")), F.lit(0.0))
    score = F.when(F.col("mode") == "rrf", both).when((F.col("mode") == "replace") & F.col("again").isNotNull(), 1 + 1.0 / (1 + F.col("again"))).otherwise(own)
    order = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), "pos")) - 1)
    first = order.groupBy(*keys).agg(F.min(F.when(F.col("expected"), F.col("r"))).alias("rank"))
    return first.groupBy("mode", "weight", "top_n").agg(F.avg(F.when(F.col("rank") < 10, 1.0).otherwise(0.0)).alias("recall"), F.avg(F.when(F.col("rank") < 10, 1.0 / (F.col("rank") + 1)).otherwise(0.0)).alias("mrr"))


def score_outcomes(pairs: DataFrame, verifier, question: str = "grounded") -> DataFrame:
    """label, score of labelled pairs (claim, evidence, label); a row that the verifier fails on has score 0."""
    from ..sources.models import ask

    return pairs.select("label", F.coalesce(ask(verifier, question)(F.col("claim"), F.col("evidence")), F.lit(0.0)).alias("score"))


def calibrate(pairs: DataFrame, verifier, question: str = "grounded") -> DataFrame:
    """One row: the errors at the question's threshold and the area under the curve of a verifier."""
    scored = score_outcomes(pairs, verifier, question)
    return calibration(scored, K.THRESHOLDS[question]).crossJoin(F.broadcast(auroc(scored)))  # one row each


def evaluate(cases: DataFrame, search, runs: int = 1, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """(run, cases, recall, mrr; their spread over the runs) of `search(cases)`, whose rows are case_no, pos, relpath,
    start_line, end_line."""
    out = None
    for run in range(1, runs + 1):
        own = summarize(first_ranks(cases, search(cases).where(F.col("pos") < limit)), limit).select(F.lit(run).alias("run"), "cases", "recall", "mrr")
        out = own if out is None else out.unionByName(own)
    return out, out.agg(*[f(c).alias(f"{c}_{n}") for c in ("recall", "mrr") for f, n in ((F.min, "low"), (F.max, "high"))])
