"""Chat formatting: conversations to one training text each, with a loss mask.

Template, per run of adjacent turns of one role:

    <turn ROLE>TEXT<cont>TEXT</turn>

Backslash, `<`, `[` (and `>` in roles) are written as `\\\\`, `\\l`, `\\b`, `\\g`, so that no control string of
this template or of the common `<s>`, `[INST]`, `<|...|>` families can occur inside a text, and reading
back is exact.  Everything is a DataFrame expression; the only shuffle groups the turns.

Defined cases: null text or role is the empty string; turns sort by number (null first), then role, then
text, and repeated rows are turns of their own; rows of a null conversation id form one conversation; an
empty table gives an empty result; other columns of the input are ignored.  A conversation becomes one
string, so it has to fit in one (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT, END = "<turn ", ">", "<cont>", "</turn>"


def escape(c: Column) -> Column:
    for raw, code in (("\\", "\\\\"), ("<", "\\l"), ("[", "\\b"), (">", "\\g")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    """An escaped text has a backslash only at the start of a code, so pairs can be split off first."""

    def part(p: Column) -> Column:
        for raw, code in (("<", "\\l"), ("[", "\\b"), (">", "\\g")):
            p = F.replace(p, F.lit(code), F.lit(raw))
        return p

    return F.array_join(F.transform(F.split(c, r"\\\\"), part), "\\")


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per conversation: its id, `formatted`, and `segments`, whose texts in order make `formatted`
    and whose `loss` flag says whether the segment is trained on (texts of the role `trained`)."""
    turns = df.groupBy(F.col(conv).alias(conv)).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")))).alias("turns")
    )
    # Blocks: the places where the role changes, then a slice of the turns for each.
    starts = turns.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])))
    ends = starts.withColumn("ends", F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns"))))
    blocks = ends.select(
        conv,
        F.zip_with("starts", "ends", lambda s, e: F.struct(F.get("turns", s)["role"].alias("role"), F.transform(F.slice("turns", s + 1, e - s), lambda t: t["text"]).alias("texts"))).alias("blocks"),
    )

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    mark = lambda value: F.array(segment(value, F.lit(False)))

    def block(b: Column) -> Column:
        texts = F.transform(b["texts"], lambda t, i: F.concat(F.when(i == 0, F.slice(mark(F.lit("")), 1, 0)).otherwise(mark(F.lit(NEXT))), F.array(segment(escape(t), b["role"] == trained))))
        return F.concat(mark(F.concat(F.lit(OPEN), escape(b["role"]), F.lit(CLOSE))), F.flatten(texts), mark(F.lit(END)))

    segments = blocks.select(conv, F.flatten(F.transform("blocks", block)).alias("segments"))
    return segments.select(conv, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as (role, text), in order."""
    cut = F.split(formatted, END)
    blocks = F.slice(cut, 1, F.size(cut) - 1)

    def turns(b: Column) -> Column:
        role = unescape(F.substring_index(F.substring(b, F.lit(len(OPEN) + 1), F.length(b)), CLOSE, 1))
        body = F.substring(b, F.locate(CLOSE, b) + len(CLOSE), F.length(b))
        return F.transform(F.split(body, NEXT), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def chat_digests(df: DataFrame) -> DataFrame:
    """What a formatted table says when it is read back."""
    read = format_chats(df).select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
