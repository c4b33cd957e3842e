"""Quotation linking: quote levels, hashed passages, links to originals, conversations without quotes.

Native: every step is a DataFrame or SQL function.

A line's level is the number of its leading ``>`` marks.  The lines of one level between lines of
other levels are passages; a passage is normalised (lower case, letters and digits, single blanks) and
hashed as a whole and sentence by sentence, so that a partial or re-wrapped quotation still meets its
original.  The original of a hash is the earliest message that has it at level 0: first in the same
conversation, else in the least other one.  A passage or sentence of under ``MIN_UNIT`` characters says
too little across conversations; a whole passage of that kind meets originals of its own conversation.  A message answers the message that most of its level-1 text comes from
(by characters, then the latest), and level n of a message belongs to level n - 1's original in turn.
A message without a linked quotation answers the one before it in its conversation.

Originals are found by an aggregate per hash, so a very common passage costs one row, and a
conversation's messages are numbered over ranges, so a very long one is not gathered in one task.

Null and empty texts are messages without passages; null conversations form one; null turns come
first; messages equal in all four columns are one after the other; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import distributed_position, top_per_group
from .common import Scratch, row_key

# The lines that mail programs put before a quotation.
ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*\ba écrit|el\b.*\bescribió|[^>]{1,80} (wrote|writes|schrieb|a écrit|escribió))\s*:\s*$"
MARKS = r"^((?:[ \t]*>)*)"
MIN_UNIT = 12                    # characters a sentence, or a passage of another conversation, needs to count as evidence


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def parsed(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with own_text, max_level, n_quoted (lines) and levels: array<struct<level, passages>>."""
    raw = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), "\n")
    lines = F.transform(raw, lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"),
        F.regexp_replace(x, MARKS, "").alias("body"), x.alias("line"),
    ))
    rows = messages.withColumn("_lines", lines)
    follows = lambda i: F.coalesce(F.get(F.col("_lines"), i + 1).getField("level"), F.lit(0)) > 0
    own = F.filter(F.col("_lines"), lambda x, i: (x.getField("level") == 0) & ~(x.getField("line").rlike(ATTRIBUTION) & follows(i)))
    levels = F.array_sort(F.array_distinct(F.transform("_lines", lambda x: x.getField("level"))))

    def passages(level: Column) -> Column:
        kept = F.transform("_lines", lambda x, i: F.when(
            (x.getField("level") == level) & ~((level == 0) & x.getField("line").rlike(ATTRIBUTION) & follows(i)),
            F.trim(x.getField("body")),
        ).otherwise(F.lit("")))
        return F.filter(F.split(F.array_join(kept, "\n"), "\n{2,}"), lambda p: normalised(p) != "")

    return rows.withColumn(
        "own_text", F.regexp_replace(F.array_join(F.transform(own, lambda x: x.getField("line")), "\n"), r"^\s+|\s+$|(?<=\n\n)\n+", "")
    ).withColumn("max_level", F.array_max(levels)).withColumn(
        "n_quoted", F.size(F.filter("_lines", lambda x: x.getField("level") > 0)).cast("bigint")
    ).withColumn("levels", F.transform(levels, lambda v: F.struct(v.alias("level"), passages(v).alias("passages")))).drop("_lines")


def units(parts: DataFrame) -> DataFrame:
    """(_key, conv, turn, level, unit, size): hashes of whole passages and of their sentences."""
    levels = parts.select("_key", "conv", "turn", F.explode("levels").alias("l"))
    flat = levels.select("_key", "conv", "turn", F.col("l.level").alias("level"), F.explode("l.passages").alias("passage"))
    sentences = F.split(F.regexp_replace("passage", r"\s+", " "), r"(?<=[.!?])\s+")
    long = F.filter(F.transform(sentences, normalised), lambda x: F.length(x) >= MIN_UNIT)
    every = F.array_union(F.array(normalised(F.col("passage"))), long)         # the passage has a letter or digit
    return flat.select("_key", "conv", "turn", "level", F.explode(F.array_distinct(every)).alias("said")).select(
        "_key", "conv", "turn", "level", F.unhex(F.md5("said")).alias("unit"), F.length("said").alias("size")
    )


def link_quotations(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per message in reply order: conv, turn, role, reply_order, own text and what it answers."""
    scratch = Scratch(messages.sparkSession)
    named = messages.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"),
        row_key(conv, turn, role, text).alias("_key"),
    )
    parts = scratch.keep("parts", parsed(named).drop("text"))
    said = units(parts)
    quoted = scratch.keep("quoted", said.where("level > 0").distinct())
    wanted = quoted.select("unit").distinct()
    held = scratch.keep("held", said.where("level = 0").join(wanted, "unit", "left_semi").select("unit", "conv", "turn", "_key").distinct())
    place = F.struct(F.col("turn").isNotNull().alias("s"), "turn", F.col("_key").alias("k"))
    near = held.groupBy("unit", "conv").agg(F.min(place).alias("near"))
    # The two least conversations that have a unit: one of them is another than the quoting one.
    holder = F.struct("conv", F.col("near.turn").alias("turn"), F.col("near.k").alias("k"))
    least = top_per_group(near.select("unit", holder.alias("holder")), ["unit"], [F.col("holder")], 2, "nth")
    far = least.groupBy("unit").agg(F.min("holder").alias("far"), F.max(F.when(F.col("nth") == 2, F.col("holder"))).alias("second"))

    found = quoted.alias("q").join(
        near.alias("n"), (F.col("q.unit") == F.col("n.unit")) & F.col("q.conv").eqNullSafe(F.col("n.conv")), "left"
    ).join(far.alias("f"), F.col("q.unit") == F.col("f.unit"), "left")
    inside = F.col("near").isNotNull() & (F.col("near.k") != F.col("q._key")) & (
        F.coalesce(F.col("near.turn") < F.col("q.turn"), F.col("q.turn").isNotNull())
    )
    other = F.when(~F.col("far.conv").eqNullSafe(F.col("q.conv")), F.col("far")).otherwise(F.col("second"))
    outside = other.isNotNull() & (F.col("size") >= MIN_UNIT)
    target = F.when(inside, F.struct(F.col("q.conv").alias("conv"), F.col("near.turn").alias("turn"), F.col("near.k").alias("k"))).when(
        outside, other
    )
    voted = found.select("q._key", "level", "size", target.alias("target"), inside.alias("inside")).where("target is not null").groupBy(
        "_key", "level", "target", "inside"
    ).agg(F.sum("size").alias("votes"))
    links = voted.groupBy("_key", "level").agg(F.max_by("target", F.struct("inside", "votes", "target")).alias("target"))
    chains = links.groupBy("_key").agg(
        F.max(F.when(F.col("level") == 1, F.col("target"))).alias("answered"),
        F.array_sort(F.collect_list(F.struct("level", F.col("target.conv").alias("conv"), F.col("target.turn").alias("turn")))).alias("sources"),
    )

    order = [F.col("turn"), F.col("_key")]
    grouped = parts.drop("levels").withColumn("_group", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("-")))
    placed = scratch.keep("placed", distributed_position(grouped, ["_group"], order, "reply_order"))
    before = placed.select("_group", (F.col("reply_order") + 1).alias("reply_order"), F.col("turn").alias("_turn"))
    rows = placed.join(before, ["_group", "reply_order"], "left").join(chains, "_key", "left")
    linked = F.col("answered").isNotNull()
    return rows.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), F.col("role").alias(role), "reply_order",
        F.when(linked, F.col("answered.conv")).when(F.col("reply_order") > 1, F.col("conv")).alias("reply_to_conv"),
        F.when(linked, F.col("answered.turn")).otherwise(F.col("_turn")).alias("reply_to_turn"),
        linked.alias("linked"), "max_level", "n_quoted", "sources", F.col("own_text").alias(text),
    )
