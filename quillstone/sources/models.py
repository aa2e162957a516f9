"""Connectors to models, run in Arrow functions; anything with these methods will do."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import render_prompt


class Chat(Protocol):
    def complete(self, prompt: str, max_tokens: int) -> str: ...


class Reranker(Protocol):
    def __call__(self, query: str, documents: list[str]) -> list[float]: ...


class Verifier(Protocol):
    def ask(self, question: str, claim: str, evidence: str) -> float: ...


class WebSearch(Protocol):
    def search(self, query: str, limit: int) -> list[dict]: ...


# What a verifier is asked.
QUESTIONS = {
    "grounded": "Is the claim supported by the evidence? Answer yes or no.\n\nClaim: {claim}\n\nEvidence: {evidence}",
    "holds": "Does the claim still hold given the current code? Answer yes or no.\n\nClaim: {claim}\n\nCode: {evidence}",
    "contradiction": "Does the code contradict the claim? Answer yes or no.\n\nClaim: {claim}\n\nCode: {evidence}",
}


def verifier_prompt(question: str, claim: Column, evidence: Column, custom: str | None = None) -> Column:
    """A custom prompt is used for `grounded` only."""
    return render_prompt(custom if custom and question == "grounded" else QUESTIONS[question], claim=claim, evidence=evidence)


def ask(verifier: Verifier, question: str):
    """(claim, evidence) columns -> probability of yes; null where the model fails."""

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for claims, evidences in batches:
            out = []
            for c, e in zip(claims.to_pylist(), evidences.to_pylist()):
                try:
                    out.append(float(verifier.ask(question, c, e)))
                except Exception:
                    out.append(None)
            yield pa.array(out, pa.float64())

    return score


def reverify(candidates: DataFrame, verifier: Verifier) -> DataFrame:
    """note_id, holds, contradiction: the second question goes only to rows that fail the first."""
    first = candidates.withColumn("holds", ask(verifier, "holds")(F.col("claim"), F.col("evidence"))).persist()
    good = first.where(F.col("holds") >= K.THRESHOLDS["holds"]).withColumn("contradiction", F.lit(None).cast("double"))
    failing = first.where(F.coalesce(F.col("holds") < K.THRESHOLDS["holds"], F.lit(True)))
    return good.unionByName(failing.withColumn("contradiction", ask(verifier, "contradiction")(F.col("claim"), F.col("evidence")))).select("note_id", "holds", "contradiction")


def complete(chat: Chat, max_tokens: int):
    """prompt column -> reply column; null where the model fails."""

    @F.arrow_udf("string")
    def reply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for prompts in batches:
            out = []
            for p in prompts.to_pylist():
                try:
                    out.append(chat.complete(p, max_tokens))
                except Exception:
                    out.append(None)
            yield pa.array(out, pa.string())

    return reply


def search_web(web: WebSearch, queries: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, pos, url, content."""

    @F.arrow_udf("array<struct<url:string,content:string>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("url", pa.string()), ("content", pa.string())]))
        for asked in batches:
            yield pa.array([[{"url": r["url"], "content": r["content"]} for r in web.search(q, limit)][:limit] for q in asked.to_pylist()], kind)

    return queries.select("query_id", F.posexplode(find(F.col("query"))).alias("pos", "r")).select("query_id", "pos", "r.*")


def hyde_inputs(queries: DataFrame, chat: Chat | None, mode: str = "auto", max_tokens: int = 120) -> DataFrame:
    """queries with `passages`: the query and, where the gate opens, a made-up answer to embed beside it."""
    from ..functions.text import route_query

    if chat is None or mode == "off":
        return queries.withColumn("passages", F.array("query"))
    gate = F.lit(True) if mode == "on" else route_query(F.col("query"))["natural_language"]
    ask_for = F.concat(F.lit("Write a short passage that answers: "), "query")
    asked = queries.where(gate).withColumn("reply", complete(chat, max_tokens)(ask_for))
    rest = queries.where(~gate).withColumn("reply", F.lit(None).cast("string"))
    return asked.unionByName(rest).withColumn("passages", F.array_compact(F.array("query", "reply"))).drop("reply")
