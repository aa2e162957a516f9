"""License scans by canonical digests.

A text is normalised (case, copyright lines, punctuation, equivalent spellings) and its SHA-256 is looked
up among the digests of known licence texts by a hash join.  The table of known texts is a constant of the
library or of the call, and its size is checked before it is broadcast.  Documents mostly carry a one-line notice
rather than a whole licence, so the digest of each line is looked up, too, among those of the known notices (a
constant of the library, about 3,000), which a set of their hashes narrows first.  All of this happens within the
row, in one scan that shuffles nothing.

Defined cases: null text is the empty text, whose digest is known to nothing; a text that holds only
copyright lines is empty too; rows that repeat a doc_id have each their own text's result; a null doc_id is an
id like any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import notices, whole_texts

COPYRIGHT = r"copyright +(\(c\)|©|[0-9])"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
#: Equivalent spellings, as beginnings of words after normalisation, in this order.
SPELLINGS = [
    (" licenc", " licens"), (" sub licens", " sublicens"), (" sublicenc", " sublicens"), (" copyright owner", " copyright holder"), (" https ", " http "), (" non commercial", " noncommercial"),
    (" acknowledgement", " acknowledgment"), (" judgement", " judgment"), (" authoris", " authoriz"), (" organis", " organiz"), (" recognis", " recogniz"), (" utilis", " utiliz"), (" initialis", " initializ"),
    (" favour", " favor"), (" labour", " labor"), (" behaviour", " behavior"), (" fulfil ", " fulfill "), (" wilful", " willful"), (" whilst ", " while "), (" programme", " program"), (" per cent ", " percent "), (" cancelled", " canceled"),
]


def canonical_lines(text: Column) -> Column:
    """The normalised lines of a text, without empty ones."""
    lines = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), lambda x: ~x.rlike(COPYRIGHT))
    body = F.regexp_replace(F.concat(F.lit(" "), F.array_join(lines, " \n "), F.lit(" ")), PUNCTUATION, " ")
    for said, same in SPELLINGS:
        body = F.replace(body, F.lit(said), F.lit(same))
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def known(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """(license, digest) of known texts."""
    # One literal, cut up by Spark: thousands of struct literals would be slow to plan.
    rows = F.split(F.lit("\x1e".join(f"{k}\x1f{t}" for k, t in pairs)), "\x1e")
    pair = F.split("x", "\x1f")
    digest = F.sha2(F.array_join(canonical_lines(F.get(pair, F.lit(1))), " "), 256)
    return spark.range(1).select(F.explode(rows).alias("x")).select(F.get(pair, F.lit(0)).alias("license"), digest.alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def notice_table(spark: SparkSession) -> list:
    """Rows (digest, license, hash) of the known notices, in order of digest; hash is of the canonical line."""
    line = F.array_join(canonical_lines(F.col("x")), " ")
    rows = spark.range(1).select(F.explode(F.split(F.lit("\x1e".join(f"{k}\x1f{t}" for k, t in notices())), "\x1e")).alias("p"))
    rows = rows.select(F.split("p", "\x1f").alias("p")).select(F.get("p", F.lit(0)).alias("license"), F.get("p", F.lit(1)).alias("x"))
    rows = rows.select("license", F.sha2(line, 256).alias("digest"), F.xxhash64(line).alias("hash"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.first("hash").alias("hash")).orderBy("digest").collect()


def scan_licenses(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, digest, license (of the whole text, or null), notices (sorted licences of its lines, comma-joined).

    `texts` are the (licence, text) known as whole texts, by default those of whole_texts()."""
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).alias("doc_id"), canonical_lines(F.col(text)).alias("lines"))
    held = notice_table(spark)
    digests, names = (F.split(F.lit("\n".join(getattr(r, c) for r in held)), "\n") for c in ("digest", "license"))
    hashes = [r.hash for r in held]
    hit = F.transform(F.filter("lines", lambda x: F.xxhash64(x).isin(hashes)), lambda x: F.array_position(digests, F.sha2(x, 256)))
    own = F.transform(F.filter(hit, lambda k: k > 0), lambda k: F.element_at(names, k.cast("int")))
    told = rows.select("doc_id", F.sha2(F.array_join("lines", " "), 256).alias("digest"), F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("notices"))
    pairs = whole_texts() if texts is None else texts
    table = known(spark, pairs)
    table = F.broadcast(table) if len(pairs) <= 100_000 else table
    return told.join(table, "digest", "left").select("doc_id", "digest", "license", "notices")
