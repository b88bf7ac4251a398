"""Chat formatting of preference pairs: the longest common turn prefix of the chosen and the rejected conversation becomes
one prompt, what follows becomes two completions with a mask over the assistant's turns.

Turns are compared turn number by turn number in one grouped pass over both sides, and the first number at which they
differ is joined back. The output has a row for each section (prompt, chosen, rejected) and part of at most PART_TURNS turn
numbers, so a conversation with a third of all rows becomes many rows of bounded length, never one task's group.

Rows of one conversation and turn number that are alike count once; different ones follow each other by role and text, as
parts of that turn. Turns without a number come last, in that same order, and count as often as they are there; null roles
and texts are rendered as empty. A pair whose sides are equal has a prompt and no completions; a pair with one side only has
no prompt. An empty table gives an empty one. Only the named columns are read, so others cannot clash.

Rows without a pair id make one pair under null. Its turns are compared likewise, by how often each side has each turn's
rows, but every row is an output row by itself and repeats count, as nothing says which conversation it is from: no list
grows with their number, and they are not shuffled but for counts of equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the rendered text. Fixed values.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
PART_TURNS = 64
LAST = (1 << 62) - 1


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(CLOSE), F.coalesce(text, F.lit("")), F.lit(END))


def head(role: Column) -> Column:
    """Characters before a rendered turn's own text: never a target."""
    return F.length(F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(CLOSE)))


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair_id, section, part, first_turn, n_turns, text, targets): targets are the [start, end) of what is learned.

    A prompt has no targets. A completion's targets are its assistant turns' texts with their end mark, as offsets of
    characters in the row's text.
    """
    side = lambda df, name: df.select(
        F.col(pair).alias("pair_id"), F.coalesce(F.col(turn).cast("long"), F.lit(LAST)).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), F.lit(name).alias("side")
    )
    every = side(chosen, "chosen").unionByName(side(rejected, "rejected"))
    rows = every.where("pair_id IS NOT NULL").groupBy("pair_id", "turn", "role", "text", "side").agg(F.count("*").alias("times"))
    times = F.when(F.col("turn") == LAST, F.col("times")).otherwise(1).cast("int")
    rows = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times)))
    said = F.struct("role", "text")
    turns = rows.groupBy("pair_id", "turn").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "chosen", said))).alias("chosen"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "rejected", said))).alias("rejected"),
    )
    same = F.coalesce(F.col("chosen") == F.col("rejected"), F.lit(False))
    first = turns.groupBy("pair_id").agg(F.coalesce(F.min(F.when(~same, F.col("turn"))), F.lit(LAST + 1)).alias("cut"))
    cut = turns.join(first, "pair_id")
    both = F.array(
        F.struct(F.lit("chosen").alias("section"), F.col("chosen").alias("said")),
        F.struct(F.lit("rejected").alias("section"), F.col("rejected").alias("said")),
    )
    shared = F.array(F.struct(F.lit("prompt").alias("section"), F.col("chosen").alias("said")))
    cut = cut.withColumn("at", F.explode(F.when(F.col("turn") < F.col("cut"), shared).otherwise(both)))
    parts = cut.where(F.size("at.said") > 0).groupBy(
        "pair_id", F.col("at.section").alias("section"), F.floor(F.col("turn") / PART_TURNS).alias("part_turns")
    ).agg(F.array_sort(F.collect_list(F.struct("turn", F.col("at.said").alias("said")))).alias("turns"))
    flat = F.flatten(F.transform("turns", lambda t: t["said"]))
    parts = parts.select("pair_id", "section", "part_turns", F.col("turns")[0]["turn"].alias("turn"), flat.alias("flat"))
    parts = parts.unionByName(_without_pair(every.where("pair_id IS NULL")))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def walk(s: Column, x: Column) -> Column:
        size = F.length(render(x["role"], x["text"]))
        span = F.struct((s["n"] + head(x["role"])).alias("start"), (s["n"] + size).alias("end"))
        return F.struct((s["n"] + size).alias("n"), F.when(x["role"] == "assistant", F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    spans = F.aggregate("flat", start, walk, lambda s: s["spans"])
    return parts.select(
        "pair_id",
        "section",
        F.when(F.col("turn") < LAST, F.col("part_turns")).alias("part"),
        F.when(F.col("turn") < LAST, F.col("turn")).alias("first_turn"),
        F.size("flat").alias("n_turns"),
        F.array_join(F.transform("flat", lambda x: render(x["role"], x["text"])), "").alias("text"),
        F.when(F.col("section") == "prompt", F.array().cast("array<struct<start:int,end:int>>")).otherwise(spans).alias("targets"),
    )


def _without_pair(rows: DataFrame) -> DataFrame:
    """(pair_id, section, part_turns, turn, flat) of the rows without a pair id, each by itself."""
    of = lambda name: F.sum((F.col("side") == name).cast("long"))
    differ = rows.groupBy("turn", "role", "text").agg((of("chosen") - of("rejected")).alias("more")).where("more <> 0")
    cut = differ.agg(F.coalesce(F.min("turn"), F.lit(LAST + 1)).alias("cut"))
    rows = rows.crossJoin(F.broadcast(cut)).where("side = 'chosen' OR turn >= cut")
    section = F.when(F.col("turn") < F.col("cut"), F.lit("prompt")).otherwise(F.col("side"))
    return rows.select("pair_id", section.alias("section"), F.floor(F.col("turn") / PART_TURNS).alias("part_turns"), "turn", F.array(F.struct("role", "text")).alias("flat"))


def with_other_reply(conversations: DataFrame) -> DataFrame:
    """Rejected sides for a table that has none: each conversation with its partner's last assistant turn for its own.

    Partners are conversations 2k and 2k + 1. Without a partner's reply, the conversation's own last reply is left out;
    without an own reply nothing changes, nor do rows without a conversation.
    """
    every = conversations.select("conv_id", "turn", "role", "text")
    df = every.where("conv_id IS NOT NULL")
    last = df.where("role = 'assistant' AND turn IS NOT NULL").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("m"))
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("m.text").alias("other_text"), F.lit(True).alias("has_other"))
    mine = last.select("conv_id", F.col("m.turn").alias("last_turn")).join(other, "conv_id", "left")
    df = df.join(mine, "conv_id", "left")
    is_last = F.coalesce((F.col("role") == "assistant") & (F.col("turn") == F.col("last_turn")), F.lit(False))
    df = df.where(~is_last | F.coalesce("has_other", F.lit(False)))
    df = df.select("conv_id", "turn", "role", F.when(is_last, F.col("other_text")).otherwise(F.col("text")).alias("text"))
    return df.unionByName(every.where("conv_id IS NULL"))
