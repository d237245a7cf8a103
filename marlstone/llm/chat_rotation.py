"""Chat formatting with every participant in turn as the assistant, in DataFrame functions only.

For each speaker of a conversation the whole dialogue is rendered with that
speaker as the assistant and the others as named users; system turns stay system
turns. The mask has the places of what the assistant says, its end mark included:
what a model is trained on. Places are running sums over the turns, so the work
grows with the length of a dialogue and not with its square.

Edge cases: turns are ordered by number (null first), then role (null first),
then text; repeated rows are repeated turns. A null text is an empty turn. A turn
without a role is said by a user without a name, who has no perspective. A
conversation of system turns alone has no perspective and so no rows; a null
conversation id is a conversation. Marks inside a text are broken up by a space.
Speakers are told apart by their roles as they are. In a rendered name, letters
and digits of any script, ``_`` and ``-`` stay, and any other character becomes
``%``, its code point in hexadecimal and ``;``, so that names stay different.
Other columns are not read. A dialogue is one row, so it is limited by what a row
can hold; ``part_turns`` cuts it to parts where that is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, SYSTEM, ASSISTANT = "<|im_start|>", "<|im_end|>", "system", "assistant"


def _safe(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(START), F.lit("<| im_start|>")), F.lit(END), F.lit("<| im_end|>"))


def _name(role: Column) -> Column:
    """The role as it is rendered; nothing but letters, marks and digits, ``_``, ``-``, ``%`` and ``;``."""
    shown = r"[\p{L}\p{M}\p{N}_-]"
    escaped = F.transform(F.regexp_extract_all(role, F.lit("(?s)."), F.lit(0)), lambda c: F.when(c.rlike(shown), c).otherwise(F.concat(F.lit("%"), F.hex(F.ascii(c)), F.lit(";"))))
    return F.when(role.rlike(rf"^{shown}*\z"), role).otherwise(F.array_join(escaped, ""))


def rotate(df: DataFrame, conversation_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int | None = None) -> DataFrame:
    """A row for each conversation and perspective: part, n_turns, rendered, mask (begin:end of what the assistant says, comma-joined, in code points).

    With ``part_turns`` a dialogue is cut to parts of so many turn numbers, a row
    each, numbered by ``part``; otherwise ``part`` is 0. One shuffle, by conversation.
    """
    part = F.lit(0) if part_turns is None else F.coalesce(F.floor(F.col(turn_col) / part_turns), F.lit(0))
    turns = df.select(F.col(conversation_col).alias("conv"), part.cast("long").alias("part"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.concat(_safe(F.col(text_col)), F.lit(END)).alias("said"))
    turns = turns.withColumn("tag", F.when(F.col("role").isNull(), "user").when(F.col("role") == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), _name(F.col("role")))))
    order = [F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc("said")]
    all_before = Window.partitionBy("conv", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own_before = Window.partitionBy("conv", "part", "role").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("tag") + F.length("said") + len(START) + 2
    # each turn of the speaker's own is longer or shorter by what "assistant" differs from the name
    before = F.coalesce(F.sum(size).over(all_before), F.lit(0)) + F.count(F.lit(1)).over(own_before) * (len(ASSISTANT) - F.length("tag"))
    placed = turns.select("conv", "part", "role", "tag", "said", F.count(F.lit(1)).over(all_before).alias("at"), (before + len(START) + len(ASSISTANT) + 1).alias("begin"))
    whole = placed.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("at", "role", "tag", "said", "begin"))).alias("turns"))
    if part_turns is None:
        speakers = F.array_distinct(F.transform("turns", lambda t: t["role"]))
        both = whole.select("conv", "part", "turns", F.explode(F.filter(speakers, lambda role: role != SYSTEM)).alias("perspective"))
    else:
        speakers = turns.filter(F.col("role") != SYSTEM).select(F.col("conv").alias("_conv"), F.col("role").alias("perspective")).distinct()
        both = whole.join(speakers, F.col("conv").eqNullSafe(F.col("_conv")))
    mine = lambda t: t["role"] == F.col("perspective")
    line = lambda t: F.concat(F.lit(START), F.when(mine(t), ASSISTANT).otherwise(t["tag"]), F.lit("\n"), t["said"], F.lit("\n"))
    span = lambda t: F.concat_ws(":", t["begin"], t["begin"] + F.length(t["said"]))
    return both.select(
        F.col("conv").alias(conversation_col),
        "perspective",
        "part",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", line), "").alias("rendered"),
        F.array_join(F.transform(F.filter("turns", mine), span), ",").alias("mask"),
    )
