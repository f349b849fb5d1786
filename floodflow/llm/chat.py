"""Chat formatting: multi-party perspective rotation.

For every participant the dialogue is rendered with that speaker as the
assistant, the others as named users and system turns as they are; the mask
lists the code point spans (the speaker's words and the end mark) to train on.

The turns of a conversation are numbered in order of turn, role and text, and a
dialogue comes in segments of ``SEGMENT_TURNS`` numbers, so no row and no group grows
with the length of a conversation, whatever its turn numbers. The numbers come from a
sort of all turns dealt out by range: a row's place in its part, after the counts of
the parts before. The segments of a perspective, joined in order, are the whole
dialogue. Mask spans count from the start of their segment. All steps are DataFrame
functions.

Defined cases: a null or empty role is the participant ``unknown``; a null text
is empty; turns without a number come first; equal turn numbers go by role, then text,
and rows that repeat are all rendered; every row without a conv_id is a conversation of
its own; a conversation of system turns alone has no participant and gives no row; the
format's marks inside a text or a role are broken up and line breaks in a role are
blanks, so neither can forge a turn. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodflow.llm.base import let, materialize

SEGMENT_TURNS = 512
SYSTEM = "system"
UNKNOWN = "unknown"
START, END = "<|im_start|>", "<|im_end|>"


def _head(turn: Column, speaker: Column) -> Column:
    return (F.when(turn["who"] == SYSTEM, F.lit(f"{START}system\n"))
            .when(turn["who"] == speaker, F.lit(f"{START}assistant\n"))
            .otherwise(F.concat(F.lit(f"{START}user name="), turn["who"], F.lit("\n"))))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``number`` of each turn in its conversation, from 0."""
    order = ["conv_id", "own", "turn", "who", "text"]
    # The random last key deals out rows that repeat.
    rows = rows.withColumn("tie", F.rand(5)).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie")
    rows = materialize(rows.drop("tie").withColumn("id", F.monotonically_increasing_id()), "chat-turns")
    key = ["conv_id", "own"]
    parts = rows.groupBy(*key, F.shiftright("id", 33).alias("part")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(
        F.col("conv_id").alias("c"), F.col("own").alias("o"), "part", "first", "before")
    return (rows.join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("own").eqNullSafe(F.col("o"))
                      & (F.shiftright("id", 33) == F.col("part")))
            .withColumn("number", F.col("before") + F.col("id") - F.col("first")).drop("c", "o"))


def perspectives(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) to one row per conversation, speaker and
    segment: conv_id, speaker, segment, n_turns, text, mask (start, end)."""
    def clean(c: Column) -> Column:
        return F.replace(c, F.lit("<|im_"), F.lit("<| im_"))

    role = clean(F.translate(F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit(UNKNOWN)), "\n\r", "  "))
    rows = _numbered(turns.select(
        "conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("own"),
        F.col("turn").cast("long").alias("turn"), role.alias("who"),
        clean(F.coalesce("text", F.lit(""))).alias("text")))
    rows = rows.select("conv_id", "own", F.floor(F.col("number") / SEGMENT_TURNS).cast("long").alias("segment"),
                       F.struct("number", "who", "text").alias("t"))
    speakers = (rows.where(F.col("t.who") != SYSTEM)
                .select(F.col("conv_id").alias("c"), F.col("own").alias("o"), F.col("t.who").alias("speaker"))
                .distinct())
    segments = (rows.groupBy("conv_id", "own", "segment")
                .agg(F.sort_array(F.collect_list("t")).alias("turns")))
    both = segments.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("own").eqNullSafe(F.col("o")))

    speaker = F.col("speaker")
    parts = F.transform("turns", lambda t: F.struct(
        _head(t, speaker).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"),
        (t["who"] == speaker).alias("own")))
    made = let(parts, lambda ps: F.struct(
        F.array_join(F.flatten(F.transform(ps, lambda p: F.array(p["head"], p["body"], F.lit("\n")))), "")
        .alias("text"), _mask(ps).alias("mask")))
    return (both.select("conv_id", "speaker", "segment", F.size("turns").cast("long").alias("n_turns"),
                        F.explode(F.array(made)).alias("m"))
            .select("conv_id", "speaker", "segment", "n_turns", "m.text", "m.mask"))


def _mask(parts: Column) -> Column:
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        return F.struct((end + 1).cast("long").alias("at"), F.when(p["own"], F.concat(a["spans"], F.array(
            F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))))
            .otherwise(a["spans"]).alias("spans"))

    return F.aggregate(parts, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), step,
                       lambda a: a["spans"])
