"""Mixing sources to target weights by entropy balancing, on built-in functions alone.

Of all document rates ``r`` whose tokens meet the targets, the ones closest to
taking every document once (in relative entropy) are ``exp(lambda * size)``
with one multiplier for each token constraint, cut at the largest number of
copies.  The multipliers solve the convex dual, by Newton steps kept inside a
bracket.  A rate depends on source and size alone, so documents are counted by
source and size once, and every step sums over that histogram.

Rates become whole copies on the histogram too: going down the sizes, the
fractions are added up and a copy is due whenever the sum passes a whole
number; what a source then misses or has too much is made up by single copies
of documents that fit.  Last, in every (source, size) the documents first in a
hashed order take the copies due.  Sums that decide are sums of whole numbers,
so that another run, on other machines, decides alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardflow.llm.exact_dedup import normalised
from shardflow.operators.ordering import dense_index
from shardflow.scratch import materialise

UNIT = 1_000_000  # rates are whole millionths
SLICES = 1024  # of the documents of one source and size, when they are ranked


def n_words(text: Column | str) -> Column:
    """Number of words; null has none."""
    flat = F.trim(normalised(text))
    return F.when(flat == "", F.lit(0)).otherwise(
        F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit(""))) + 1
    ).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Add ``target`` to ``(s, source_size)``, one row per source.

    Sources, by code point and null last, take the weights in turn.  They share
    ``share`` times all tokens by weight; what would lift one above ``cap``
    times its own size is shared by the others.
    """
    turn = F.row_number().over(Window.orderBy(F.col("s.source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn % len(weights) + 1).cast("int"))
    table = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    # Sources in the order in which they fill up; those before a source are full.
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("s.source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    table = table.withColumn("level", level).withColumn("place", F.row_number().over(order))
    full = F.col("most") <= F.col("level") * F.col("w")
    open_level = F.min_by(F.when(~full, F.col("level")), F.when(~full, F.col("place"))).over(whole)
    return table.withColumn("target", F.when(full, F.col("most")).otherwise(open_level * F.col("w"))).select("s", "source_size", "target")


def _rate(lam: str, x: str, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.col(lam) * F.col(x), F.lit(50.0))))


def _exact_sum(value: Column) -> Column:
    """A sum that does not depend on the order of rows."""
    return F.sum(F.round(value * (1 << 20)).cast("decimal(38,0)")).cast("double") / (1 << 20)


def multipliers(histogram: DataFrame, wanted: DataFrame, cap: int, tolerance: float = 1e-9) -> DataFrame:
    """``(s, lam)`` for every source whose target is neither zero nor its most.

    ``histogram`` has ``(s, size, n)`` without size 0; ``x`` is the size in
    units of the source's mean.  A source is done when its sum is within
    ``tolerance`` of its target, or when no number is left between its bounds.
    """
    base = histogram.groupBy("s").agg(F.sum("n").alias("docs"), F.min("size").alias("least"))
    start = wanted.join(base, "s").where(f"target > 0 and target < source_size * {cap}")
    start = start.withColumn("scale", F.col("source_size") / F.col("docs")).withColumn("log", F.log(F.col("target") / F.col("source_size")))
    far = F.col("scale") / F.col("least")
    state = start.select(
        "s", "target", "scale", F.col("log").alias("lam"),
        F.when(F.col("log") < 0, F.col("log") * far).otherwise(F.lit(0.0)).alias("lo"),
        F.when(F.col("log") < 0, F.lit(0.0)).otherwise(F.log(F.lit(float(cap))) * far).alias("hi"),
        F.lit(1.0).alias("off"),
    )
    state = materialise(state, "multipliers")
    while True:
        held = histogram.join(state, "s").withColumn("x", F.col("size") / F.col("scale"))
        held = held.withColumn("r", _rate("lam", "x", cap)).withColumn("mass", F.col("n") * F.col("size") * F.col("r"))
        sums = held.groupBy("s").agg(
            _exact_sum(F.col("mass")).alias("sum"),
            _exact_sum(F.when(F.col("r") < cap, F.col("mass") * F.col("x")).otherwise(F.lit(0.0))).alias("slope"),
        )
        gap = F.col("sum") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.when(F.col("slope") > 0, F.col("lam") - gap / F.col("slope"))
        step = state.join(sums, "s").select("s", "target", "scale", "lam", lo.alias("lo"), hi.alias("hi"), newton.alias("to"), (F.abs(gap) / F.col("target")).alias("off"))
        inside = (F.col("to") > F.col("lo")) & (F.col("to") < F.col("hi"))
        moved = F.when(F.col("off") <= tolerance, F.col("lam")).when(inside, F.col("to")).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = materialise(step.select("s", "target", "scale", moved.alias("lam"), "lo", "hi", "off"), "multipliers")
        between = F.col("hi") - F.col("lo") > F.greatest(F.abs("lo"), F.abs("hi")) * 1e-15
        if state.where((F.col("off") > tolerance) & between).isEmpty():
            break
    return state.select("s", "scale", "lam")


def copies_due(histogram: DataFrame, wanted: DataFrame, cap: int) -> DataFrame:
    """``(s, size, rate, base, due)``: of the documents of a source and size all take
    ``base`` copies, and ``due`` of them one more (or one less, below zero).

    Rounding leaves some words missing or over; every round brings a source
    nearer to its target, until no document that is free would.
    """
    lam = multipliers(histogram, wanted, cap)
    table = histogram.join(wanted, "s").join(lam, "s", "left").withColumn("x", F.col("size") / F.col("scale"))
    rate = (
        F.when(F.col("target") <= 0, F.lit(0.0))
        .when(F.col("target") >= F.col("source_size") * cap, F.lit(float(cap)))
        .otherwise(_rate("lam", "x", cap))
    )
    table = table.withColumn("rate", F.round(rate * UNIT).cast("bigint"))
    table = table.withColumn("base", F.expr(f"rate div {UNIT}")).withColumn("part", F.col("n") * (F.col("rate") % UNIT))
    down = Window.partitionBy("s").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = table.withColumn("upto", F.sum("part").over(down) + UNIT // 2)
    table = table.withColumn("due", F.expr(f"upto div {UNIT} - (upto - part) div {UNIT}"))
    table = materialise(table.select("s", "size", "n", "rate", "base", "due", "target"), "copies")
    while True:
        taken = table.groupBy("s").agg(F.sum(F.expr("size * (n * base + due)")).alias("taken"), F.round(F.first("target")).cast("bigint").alias("goal"))
        room = table.join(taken, "s").withColumn("miss", F.col("goal") - F.col("taken"))
        # Documents that can still take one more, or give one back.
        free = F.when(F.col("miss") > 0, F.when(F.col("base") + 1 <= cap, F.col("n") - F.col("due")).otherwise(-F.col("due")))
        free = free.otherwise(F.when(F.col("base") >= 1, F.col("n") + F.col("due")).otherwise(F.col("due")))
        # The size nearest to what is missing; one that is larger must still bring the sum nearer.
        room = room.withColumn("free", free).where("free > 0 and size < 2 * abs(miss)")
        apart = F.expr("2 * abs(size - abs(miss)) + if(size > abs(miss), 1, 0)")
        pick = room.groupBy("s").agg(F.min_by("size", apart).alias("size"))
        move = room.join(pick, ["s", "size"]).select(
            "s", "size", F.expr("cast(sign(miss) as bigint) * least(free, greatest(1L, abs(miss) div size))").alias("move")
        )
        move = materialise(move, "moves")
        if move.isEmpty():
            break
        table = materialise(
            table.join(move, ["s", "size"], "left").withColumn("due", F.col("due") + F.coalesce("move", F.lit(0).cast("bigint"))).drop("move"),
            "copies",
        )
    return table.select("s", "size", "rate", "base", "due")


def mixture(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    seed: int = 0,
) -> DataFrame:
    """``(<id>, size, source_size, target, taken, copies, rate)``, one row per row of ``docs``.

    ``size`` counts words; a null text has none.  A null source is a source of
    its own and comes last.  ``taken`` is ``copies * size``; ``copies`` is at
    most ``cap``.  Documents without words take no copy, and a source without
    words has the target 0.  The sum taken from a source ends near its target: no
    single copy more or less of any document would bring it nearer (after at most a
    dozen corrections).
    Rows with equal id, source and size may take different numbers of copies,
    in no fixed order.  Other columns are not looked at.
    """
    sized = docs.select(F.col(id).cast("bigint").alias("id"), F.struct(F.col(source).alias("source")).alias("s"), n_words(text).alias("size"))
    sized = materialise(sized, "sizes")
    counts = sized.groupBy("s", "size").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts, "size-counts")
    wanted = counts.groupBy("s").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    wanted = materialise(targets(wanted, weights, share, cap), "targets")
    due = copies_due(counts.where("size > 0"), wanted, cap)
    # Rank in a hashed order inside (source, size): slices, then inside a slice.
    ranked = sized.withColumn("h", F.xxhash64(F.lit(seed), "id")).withColumn("slice", F.pmod("h", F.lit(SLICES)).cast("int"))
    slices = ranked.groupBy("s", "size", "slice").agg(F.count(F.lit(1)).alias("n"))
    over = Window.partitionBy("s", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = slices.select("s", "size", "slice", (F.sum("n").over(over) - F.col("n")).alias("before"))
    slices = slices.join(due, ["s", "size"], "left").join(wanted, "s")
    inner = Window.partitionBy("s", "size", "slice").orderBy("h", "id")
    placed = ranked.join(slices, ["s", "size", "slice"]).withColumn("rank", F.col("before") + F.row_number().over(inner) - 1)
    extra = F.when(F.col("rank") < F.abs("due"), F.sign("due").cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    copies = F.coalesce(F.col("base") + extra, F.lit(0).cast("bigint"))
    return placed.select(
        F.col("id").alias(id),
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).alias("taken"),
        copies.alias("copies"),
        (F.coalesce("rate", F.lit(0).cast("bigint")) / UNIT).alias("rate"),
    )


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them, with all their columns, whatever their names.

    Rows that share an id share the copies of all of them evenly, those without
    an id likewise; which of them take one more is in no fixed order.
    """
    plan = mixture(docs, id, text, source, **options).groupBy(F.col(id).alias("id"))
    plan = plan.agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0")
    plan = materialise(plan, "mixture")
    mine = docs.select(F.struct("*").alias("row"), F.col(id).cast("bigint").alias("id"))
    named = mine.where("id is not null")
    taken = named.join(plan.where("n = 1").select("id", "copies"), "id").select("row", "copies")
    repeated = materialise(plan.where("n > 1"), "repeated-ids")
    if not repeated.isEmpty():
        # Rows get a number once, written with them; they are ranked by it without their columns.
        several = named.join(repeated.select("id"), "id", "left_semi").unionByName(mine.where("id is null"))
        several = materialise(several.withColumn("k", F.monotonically_increasing_id()), "repeated-rows")
        ranked = dense_index(several.select("k", "id"), ["k"], within=["id"], index="turn")
        ranked = ranked.withColumn("of", F.struct("id")).join(repeated.select(F.struct("id").alias("of"), "copies", "n"), "of")
        own = F.expr("copies div n + if(turn < copies % n, 1, 0)").alias("copies")
        taken = taken.unionByName(several.join(ranked.select("k", own), "k").select("row", "copies"))
    return taken.select("row", F.explode(F.expr("array_repeat(0, cast(copies as int))"))).select("row.*")
