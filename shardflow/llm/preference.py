"""Chat formatting of preference pairs, on built-in functions alone.

A chosen and a rejected conversation share a prefix of turns.  It is found by
comparing the turns at the same place, rendered once as the prompt, and the two
rests are rendered as completions, with the ranges of letters to learn from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardflow.operators.ordering import dense_index

#: How a turn is written: before the role, between role and text, after the text.
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def opening_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(pair_id, chosen, rejected)``: conversations with one opening, two by two.

    Where a table has no judgements, conversations that open with the same turn
    (smallest number, ties by role and text) are paired in a hashed order; of a
    pair the first is taken as chosen.  An opening with an odd number of conversations
    leaves its last one without a partner: ``rejected`` is null.  A pair is named
    after its chosen conversation.  An opening shared by any number of
    conversations is spread over many tasks.
    """
    some = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("c"), F.col(turn).cast("bigint").alias("t"), F.coalesce(role, F.lit("")).alias("r"),
        F.coalesce(text, F.lit("")).alias("x"),
    )
    opening = some.groupBy("c").agg(F.min(F.struct("t", "r", "x")).alias("first"))
    opening = opening.select("c", F.sha2(F.concat_ws("\x00", "first.r", "first.x"), 256).alias("opening"))
    order = dense_index(opening, ["c"], within=["opening"], index="i")
    half = order.select("c", "opening", F.expr("i div 2").alias("pair"), (F.col("i") % 2).alias("side"))
    return half.groupBy("opening", "pair").agg(
        F.max(F.when(F.col("side") == 0, F.col("c"))).alias("chosen"), F.max(F.when(F.col("side") == 1, F.col("c"))).alias("rejected")
    ).select(F.col("chosen").alias("pair_id"), "chosen", "rejected")


def format_preferences(
    pairs: DataFrame,
    turns: DataFrame,
    *,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn: Sequence[str] = ("assistant",),
    template: Sequence[str] = TEMPLATE,
) -> DataFrame:
    """``(pair_id, chosen, rejected, prompt_turns, prompt, chosen_completion,
    rejected_completion, chosen_mask, rejected_mask)``, one row per row of ``pairs``.

    Turns are in the order of their numbers; equal numbers go by role and text,
    repeated rows stay, and a null number comes first.  Turns are the same
    when role and text are (null counts as empty).  ``prompt_turns`` is the
    length of the longest common prefix; it is never the whole of both: of two
    equal conversations both completions are empty, and of a pair where one
    continues the other, one is.  A conversation that is null or without turns
    has no turn, so the prompt is empty.  Masks list ``(start, end)`` in letters
    of a completion, for the texts of turns whose role is in ``learn``.
    """
    before, between, after = template
    seats = Window.partitionBy("c").orderBy("t", "r", "x")
    held = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("c"), F.col(turn).cast("bigint").alias("t"), F.coalesce(role, F.lit("")).alias("r"),
        F.coalesce(text, F.lit("")).alias("x"),
    ).withColumn("k", F.row_number().over(seats) - 1).drop("t")
    whole = held.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("k", "r", "x"))).alias("turns"))
    nothing = F.array().cast("array<struct<k:int,r:string,x:string>>")
    both = pairs.select("pair_id", "chosen", "rejected")
    for side in ("chosen", "rejected"):
        both = both.join(whole.select(F.col("c").alias(side), F.col("turns").alias(f"{side}_turns")), side, "left")
        both = both.withColumn(f"{side}_turns", F.coalesce(f"{side}_turns", nothing))
    # The first place where the turns differ, or the end of the shorter one.
    meet = F.arrays_zip(F.col("chosen_turns").alias("a"), F.col("rejected_turns").alias("b"))
    same = lambda p: (p["a"]["r"] == p["b"]["r"]) & (p["a"]["x"] == p["b"]["x"])
    differ = F.array_position(F.transform(meet, lambda p: F.coalesce(same(p), F.lit(False))), F.lit(False))
    both = both.withColumn("prompt_turns", F.when(differ > 0, differ - 1).otherwise(F.size("chosen_turns")).cast("int"))

    def written(part):
        return F.array_join(
            F.transform(part, lambda t: F.concat(F.lit(before), t["r"], F.lit(between), t["x"], F.lit(after))), ""
        )

    def mask(part):
        head = lambda t: F.length(t["r"]) + len(before) + len(between)
        full = lambda t: head(t) + F.length(t["x"]) + len(after)
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def step(acc, t):
            span = F.struct((acc["at"] + head(t)).alias("start"), (acc["at"] + head(t) + F.length(t["x"])).alias("end"))
            spans = F.when(t["r"].isin(*learn), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
            return F.struct((acc["at"] + full(t)).alias("at"), spans.alias("spans"))

        return F.aggregate(part, start, step, lambda acc: acc["spans"])

    rest = {s: F.slice(F.col(f"{s}_turns"), F.col("prompt_turns") + 1, F.greatest(F.size(f"{s}_turns"), F.lit(1))) for s in ("chosen", "rejected")}
    return both.select(
        "pair_id", "chosen", "rejected", "prompt_turns",
        written(F.slice("chosen_turns", F.lit(1), F.col("prompt_turns"))).alias("prompt"),
        *[written(rest[s]).alias(f"{s}_completion") for s in rest],
        *[mask(rest[s]).alias(f"{s}_mask") for s in rest],
    )
