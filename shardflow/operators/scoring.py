"""Scores, rankings and comparison tables over the loaders' mean statistics.

Input has one row per loader: ``loader, total_time, images_per_sec,
avg_data_load_time, avg_cpu, avg_ram``.  Ties go to the row that comes first
by ``order`` (the loader name, or the position in a report).

Windows over all rows here see one row per loader, never runs or batches.
Best values come from such a window and not from a second aggregate, so that
telemetry is read once and a value equals the best one exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Score, its metric, and whether a higher metric is better.
SCORES = (
    ("speed", "images_per_sec", True),
    ("efficiency", "total_time", False),
    ("memory", "avg_ram", False),
    ("cpu", "avg_cpu", False),
    ("load_time", "avg_data_load_time", False),
)
# The two sets of weights.
WEIGHTS_FIVE = {"speed": 0.35, "efficiency": 0.35, "memory": 0.15, "cpu": 0.10, "load_time": 0.05}
WEIGHTS_FOUR = {"speed": 0.4, "efficiency": 0.4, "memory": 0.1, "cpu": 0.1}
# The rows of the comparison table, and whether the best cell is marked.
TABLE_ROWS = (
    ("total_time", False, True),
    ("images_per_sec", True, True),
    ("avg_cpu", False, False),
    ("avg_ram", False, True),
    ("avg_data_load_time", False, True),
)
# Use case and the score that decides it.
USE_CASES = (("throughput", "speed"), ("memory", "memory"), ("balanced", "overall"), ("cpu", "cpu"))
MARK = "✓"


def mean_row(
    rows: DataFrame,
    *,
    by: str = "loader",
    name: str = "run_id",
    line: str = "line",
    names: Sequence[str] = ("mean", "average"),
    ignore_case: bool = True,
) -> DataFrame:
    """The first row of each report whose name is one of ``names``."""
    got = F.trim(name)
    hit = F.lower(got).isin([n.lower() for n in names]) if ignore_case else got.isin(list(names))
    rest = [c for c in rows.columns if c not in (by, line)]
    first = F.min_by(F.struct(*rest), line)
    return rows.where(hit).groupBy(by).agg(F.min(line).alias(line), first.alias("_row")).select(by, line, "_row.*")


def score_columns(stats: DataFrame) -> dict[str, Column]:
    """0..100 for each score whose metric is there; a metric of zero scores zero."""
    loaders = Window.partitionBy()
    out = {}
    for score, metric, up in SCORES:
        if metric in stats.columns:
            value, top = F.col(metric), (F.max if up else F.min)(metric).over(loaders)
            share = F.when(top > 0, value / top) if up else F.when(value > 0, top / value)
            out[score] = share.otherwise(0.0) * 100
    return out


def scores(stats: DataFrame, weights: Mapping[str, float] = WEIGHTS_FIVE, clamp: bool = False) -> DataFrame:
    """Add the scores and their weighted sum ``overall``."""
    got = stats.withColumns(score_columns(stats))
    overall = sum((F.col(s) * w for s, w in weights.items()), F.lit(0.0))
    if clamp:
        overall = F.greatest(F.lit(0.0), F.least(F.lit(100.0), overall))
    return got.withColumn("overall", overall)


def leaderboard(scored: DataFrame, order: str = "loader") -> DataFrame:
    """Rank the loaders by overall score."""
    place = Window.orderBy(F.desc("overall"), F.asc(order))
    return scored.withColumn("rank", F.row_number().over(place).cast("bigint"))


def top(scored: DataFrame, n: int, order: str = "loader") -> DataFrame:
    return scored.orderBy(F.desc("overall"), F.asc(order)).limit(n)


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value)


def _directed(metric: str = "metric", value: str = "value") -> Column:
    """The value with its sign set so that smaller is better."""
    rising = [m for _, m, up in SCORES if up]
    return F.when(F.col(metric).isin(rising), -F.col(value)).otherwise(F.col(value))


def _long(stats: DataFrame, order: str) -> DataFrame:
    return unpivot(stats.withColumn("_order", F.col(order)), ["loader", "_order"], [m for _, m, _ in SCORES])


def metric_rankings(stats: DataFrame, order: str = "loader") -> DataFrame:
    """``metric, loader, value, rank`` for each of the five metrics."""
    place = Window.partitionBy("metric").orderBy(_directed(), "_order")
    return _long(stats, order).select(
        "metric", "loader", "value", F.row_number().over(place).cast("bigint").alias("rank")
    )


def best_by_metric(stats: DataFrame, order: str = "loader") -> DataFrame:
    """The best loader of each metric; an aggregate, the first of equal ones wins."""
    first = F.min(F.struct(_directed().alias("_v"), "_order", "loader", "value"))
    return _long(stats, order).groupBy("metric").agg(first.alias("_f")).select("metric", "_f.loader", "_f.value")


def score_breakdown(scored: DataFrame, weights: Mapping[str, float] = WEIGHTS_FIVE) -> DataFrame:
    """What each score adds to the overall one."""
    parts = unpivot(scored, ["loader"], list(weights), "part", "score")
    weight = F.create_map(*[F.lit(v) for kv in weights.items() for v in kv])
    return parts.withColumn("weight", weight[F.col("part")]).withColumn("points", F.col("score") * F.col("weight"))


def recommendations(scored: DataFrame, order: str = "loader") -> DataFrame:
    """The loader to take for each use case, and the score that says so."""
    cases = F.array(*[F.struct(F.lit(u).alias("use_case"), F.col(s).alias("score")) for u, s in USE_CASES])
    long = scored.select("loader", F.col(order).alias("_order"), F.inline(cases))
    first = F.min(F.struct((-F.col("score")).alias("_v"), "_order", "loader", "score"))
    return long.groupBy("use_case").agg(first.alias("_f")).select("use_case", "_f.loader", "_f.score")


def speedup(stats: DataFrame, metric: str = "images_per_sec", order: str = "loader") -> DataFrame:
    """How many times faster the best loader is than the slowest of the others."""
    place = Window.orderBy(F.desc(metric), F.asc(order))
    ranked = stats.select("loader", F.col(metric).alias("_v"), F.row_number().over(place).alias("_rank"))
    first = F.col("_rank") == 1
    got = ranked.agg(
        F.max(F.when(first, F.col("loader"))).alias("loader"),
        F.max(F.when(first, F.col("_v"))).alias("best"),
        F.min(F.when(~first, F.col("_v"))).alias("slowest"),
    )
    return got.withColumn("speedup", F.try_divide("best", "slowest"))


def best_marks(stats: DataFrame) -> DataFrame:
    """``metric, loader, value, mark``: a mark on every value equal to the best one."""
    long = unpivot(stats, ["loader"], [m for m, _, _ in TABLE_ROWS])
    metric = Window.partitionBy("metric")
    rising = F.col("metric").isin([m for m, up, _ in TABLE_ROWS if up])
    best = F.when(rising, F.max("value").over(metric)).otherwise(F.min("value").over(metric))
    marked = F.col("metric").isin([m for m, _, marked in TABLE_ROWS if marked])
    return long.withColumn("mark", F.when(marked & (F.col("value") == best), MARK).otherwise(""))


def comparison_cells(stats: DataFrame) -> DataFrame:
    """``metric, loader, value, better`` for every loader there is."""
    rising = F.col("metric").isin([m for m, up, _ in TABLE_ROWS if up])
    long = unpivot(stats, ["loader"], [m for m, _, _ in TABLE_ROWS])
    return long.withColumn("better", F.when(rising, "higher").otherwise("lower"))


def comparison_table(stats: DataFrame, loaders: Sequence[str]) -> DataFrame:
    """One row per metric, one column per loader, and which direction is better."""
    long = unpivot(stats, ["loader"], [m for m, _, _ in TABLE_ROWS])
    better = F.lit("lower")
    for metric, up, _ in TABLE_ROWS:
        better = F.when(F.col("metric") == metric, "higher").otherwise(better) if up else better
    wide = long.groupBy("metric").pivot("loader", list(loaders)).agg(F.first("value"))
    return wide.withColumn("better", better)
