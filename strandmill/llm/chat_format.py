"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker as the assistant and
all others as named users; the mask covers what the assistant says, with the end mark.

Input: conv_id, turn, role, text.  A conversation's turns are ordered by turn, then role, then text (ties and
repeated rows all stay).  Null role: a speaker of their own, ``%null``; null text: an empty turn; null turn: first;
null conv_id: a conversation of its own.  Different roles are different speakers, whose names are percent-encoded
where they need be; what looks like a marker in a turn is escaped, so that no turn can forge another.  Speakers named in ``fixed`` (system prompts) are rendered under
their own name in every perspective and get no perspective.  A conversation in which only they speak gives no
row; an empty table gives none.

Result: conv_id, perspective, part (from 0), n_turns, text, start (code points of the rendering before this
part) and mask (spans, in code points of the part).  A rendering is cut between turns into parts of about
``part_chars``, so that no row grows with its conversation; the parts in order, joined, are the rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART_CHARS = 1 << 20


#: Characters that a speaker's name has as percent-encoded bytes: % first, then what ends a line or could close the header.
NAMES = {c: "".join(f"%{b:02X}" for b in c.encode()) for c in "% \t\n\x0b\x0c\r\x85\u2028\u2029<>|"}
NOBODY = "%null"
#: Turns whose sizes are summed before the sums are.
TILE_BITS = 10


def speaker(role: Column) -> Column:
    """Names stay on one line, can't close the header, and differ where roles do."""
    out = role.cast("string")
    for c, shown in NAMES.items():
        out = F.replace(out, F.lit(c), F.lit(shown))
    return F.coalesce(out, F.lit(NOBODY))


def said(text: Column) -> Column:
    """No marker can stand in a turn: each <| has one more bar; the replacement of <|| by <| restores the text."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<||"))


def rotate(turns: DataFrame, *, fixed: tuple[str, ...] = ("system",), part_chars: int = PART_CHARS) -> DataFrame:
    # ``id`` is conv_id without nulls, so that joins and windows deal rows by the same keys; what can be derived isn't shuffled.
    key = F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    tile = F.coalesce(F.shiftright(F.col("turn").cast("long"), TILE_BITS), F.lit(-(1 << 62)))
    spoken = turns.select(key.alias("id"), "conv_id", "turn", tile.alias("tile"), speaker(F.col("role")).alias("role"), said(F.col("text")).alias("text"))
    speakers = spoken.where(~F.col("role").isin(*fixed)).select("id", F.col("role").alias("perspective")).distinct()
    every = spoken.join(speakers, "id")
    mine = F.col("role") == F.col("perspective")
    head = F.when(F.col("role").isin(*fixed), F.concat(F.lit("<|im_start|>"), "role", F.lit("\n")))
    head = head.when(mine, F.lit("<|im_start|>assistant\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), "role", F.lit("\n")))
    body = F.concat("text", F.lit("<|im_end|>"))
    size = (F.length(head) + F.length(body) + 1).cast("long")
    # Where a turn starts: sums within tiles of turns, and over the tiles' sums, so that no task orders a whole conversation.
    within = ["id", "perspective", "tile"]
    tiles = every.groupBy(*within).agg(F.sum(size).alias("total"))
    before = F.sum("total").over(W.partitionBy("id", "perspective").orderBy("tile")) - F.col("total")
    order = W.partitionBy(*within).orderBy("turn", "role", "text")
    inside = F.sum(size).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - size
    placed = every.withColumn("inside", inside).join(tiles.select(*within, before.alias("before")), within)
    placed = placed.withColumn("at", F.col("before") + F.col("inside")).withColumn("part", F.floor(F.col("at") / part_chars).cast("int"))
    placed = placed.select("conv_id", "perspective", "part", "at", head.alias("head"), body.alias("body"), mine.alias("mine"))
    turn = F.struct("at", F.concat("head", "body", F.lit("\n")).alias("said"), "mine", F.length("head").alias("n_head"), F.length("body").alias("n_body"))
    parts = placed.groupBy("conv_id", "perspective", "part").agg(F.min("at").alias("start"), F.count("*").alias("n_turns"), F.sort_array(F.collect_list(turn)).alias("t"))
    mask = F.transform(F.filter("t", lambda x: x["mine"]), lambda x: F.struct((x["at"] + x["n_head"] - F.col("start")).alias("start"), (x["at"] + x["n_head"] + x["n_body"] - F.col("start")).alias("end")))
    return parts.select("conv_id", "perspective", "part", "n_turns", F.array_join(F.transform("t", lambda x: x["said"]), "").alias("text"), "start", mask.alias("mask"))
