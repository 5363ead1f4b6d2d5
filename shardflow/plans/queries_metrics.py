"""Registered queries on telemetry, run records, scores and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardflow.functions import columns as C
from shardflow.operators import samples, scoring, telemetry
from shardflow.plans import loading, stand_ins as V
from shardflow.plans.registry import query
from shardflow.plans.stand_ins import with_sql

M = telemetry.RUN_METRICS
SCORE_NAMES = [s for s, _, _ in scoring.SCORES]


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def rounded_sql(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) as {c}" for c in columns)


def _runs(spark, sf_dir):
    return telemetry.run_records(V.telemetry(spark, sf_dir))


def _stats(spark, sf_dir):
    return telemetry.mean_statistics(_runs(spark, sf_dir))


def _scored(spark, sf_dir):
    return scoring.scores(_stats(spark, sf_dir))


RUN_NUMBERS = [m for m in M if m != "total_images"]


@query("total_images", with_sql("runs") + "select loader, run_id, total_images from runs")
def total_images(spark, sf_dir):
    tel = V.telemetry(spark, sf_dir)
    return tel.groupBy("loader", "run_id").agg(F.sum("n_images").cast("bigint").alias("total_images"))


@query("batch_count", with_sql("telemetry") + "select loader, run_id, count(*) as n_batches from telemetry group by 1, 2")
def batch_count(spark, sf_dir):
    return V.telemetry(spark, sf_dir).groupBy("loader", "run_id").agg(F.count(F.lit(1)).alias("n_batches"))


@query("elapsed", with_sql("runs") + f"select loader, run_id, {rounded_sql('total_time')} from runs")
def elapsed(spark, sf_dir):
    got = V.telemetry(spark, sf_dir).groupBy("loader", "run_id").agg(telemetry.elapsed().alias("total_time"))
    return rounded(got, "total_time")


@query("throughput", with_sql("runs") + f"select loader, run_id, {rounded_sql('images_per_sec', digits=9)} from runs")
def throughput(spark, sf_dir):
    got = V.telemetry(spark, sf_dir).groupBy("loader", "run_id").agg(
        C.rate(F.sum("n_images"), telemetry.elapsed()).alias("images_per_sec")
    )
    return rounded(got, "images_per_sec", digits=9)


@query("mean_load", with_sql("runs") + f"select loader, run_id, {rounded_sql('avg_data_load_time')} from runs")
def mean_load(spark, sf_dir):
    got = V.telemetry(spark, sf_dir).groupBy("loader", "run_id").agg(
        telemetry.exact_mean("load_time").alias("avg_data_load_time")
    )
    return rounded(got, "avg_data_load_time")


@query("mean_resources", with_sql("runs") + f"select loader, run_id, {rounded_sql('avg_cpu', 'avg_ram')} from runs")
def mean_resources(spark, sf_dir):
    got = V.telemetry(spark, sf_dir).groupBy("loader", "run_id").agg(
        telemetry.exact_mean("cpu").alias("avg_cpu"), telemetry.exact_mean("ram").alias("avg_ram")
    )
    return rounded(got, "avg_cpu", "avg_ram")


RUN_SQL = f"select loader, run_id, total_images, {rounded_sql(*RUN_NUMBERS)} from runs"


@query("run_record", with_sql("runs") + RUN_SQL)
def run_record(spark, sf_dir):
    return rounded(_runs(spark, sf_dir), *RUN_NUMBERS)


def _stat_sql(name: str, fn: str) -> str:
    return f"select loader, '{name}' as statistic, " + ", ".join(f"round({fn}({m}), 6) as {m}" for m in M) + " from runs group by loader"


BOTH_SQL = f"{_stat_sql('mean', 'avg')} union all {_stat_sql('std', 'stddev_pop')}"


@query("run_stats", with_sql("runs") + BOTH_SQL)
def run_stats(spark, sf_dir):
    return rounded(telemetry.run_statistics(_runs(spark, sf_dir)), *M)


@query(
    "run_report",
    with_sql("runs")
    + f"""select 'run' as section, loader, cast(run_id as varchar) as name, {rounded_sql(*M)} from runs
union all select 'statistic', loader, statistic, {', '.join(M)} from ({BOTH_SQL})""",
)
def run_report(spark, sf_dir):
    """The tidy form of the report: run rows and mean and std rows."""
    runs = _runs(spark, sf_dir)
    stats = telemetry.run_statistics(runs)
    a = runs.select(F.lit("run").alias("section"), "loader", F.col("run_id").cast("string").alias("name"), *M)
    b = stats.select(F.lit("statistic").alias("section"), "loader", F.col("statistic").alias("name"), *M)
    a = a.withColumn("total_images", F.col("total_images").cast("double"))
    return rounded(samples.union_sources(a, b), *M)


@query(
    "union_runs",
    with_sql("runs")
    + f"""select loader, run_id, total_images, {rounded_sql(*RUN_NUMBERS)},
  case when loader = 'view' then round(gpu, 6) end as avg_gpu_util
from runs join (select loader, run_id, avg(event_id % 101) as gpu from telemetry group by 1, 2) using (loader, run_id)""",
)
def union_runs(spark, sf_dir):
    """Runs of one loader with GPU use, of the others without."""
    tel = V.telemetry(spark, sf_dir)
    gpu = tel.where("loader = 'view'").withColumn("gpu_util", F.col("event_id") % 101)
    some = telemetry.run_records(gpu, extra=["gpu_util"])
    rest = telemetry.run_records(tel.where("loader <> 'view' or loader is null"))
    return rounded(samples.union_sources(rest, some), *RUN_NUMBERS, "avg_gpu_util")


@query(
    "batch_latency",
    with_sql("telemetry")
    + """select loader, run_id, event_id, (epoch_us(ts) - epoch_us(before)) / 1e6 as latency
from (select *, coalesce(lag(ts) over (partition by loader, run_id order by ts, event_id), date_trunc('day', ts)) as before
  from telemetry)""",
)
def batch_latency(spark, sf_dir):
    got = telemetry.run_sequence(V.telemetry(spark, sf_dir), F.date_trunc("day", "ts"))
    return got.select("loader", "run_id", "event_id", "latency")


@query(
    "running_total",
    with_sql("telemetry")
    + """select loader, run_id, event_id, row_number() over w - 1 as batch, cast(sum(n_images) over w as bigint) as images_so_far
from telemetry window w as (partition by loader, run_id order by ts, event_id rows unbounded preceding)""",
)
def running_total(spark, sf_dir):
    got = telemetry.run_sequence(V.telemetry(spark, sf_dir))
    return got.select("loader", "run_id", "event_id", "batch", "images_so_far")


@query(
    "first_batch",
    with_sql("telemetry")
    + """select loader, run_id, event_id, n_images from (
  select *, row_number() over (partition by loader, run_id order by ts, event_id) as r from telemetry) where r = 1""",
)
def first_batch(spark, sf_dir):
    return telemetry.first_batches(V.telemetry(spark, sf_dir)).select("loader", "run_id", "event_id", "n_images")


# --- scores and rankings -------------------------------------------------------------


@query(
    "mean_row",
    with_sql("runs") + _stat_sql("Mean ", "avg"),
)
def mean_row(spark, sf_dir):
    """The mean row of reports with the names ``Mean``, ``AVERAGE`` (later) and ``std``."""
    stats = telemetry.run_statistics(_runs(spark, sf_dir))
    mean = stats.where("statistic = 'mean'").withColumns({"statistic": F.lit("Mean "), "line": F.lit(1)})
    later = stats.where("statistic = 'std'").withColumns({"statistic": F.lit("AVERAGE"), "line": F.lit(2)})
    rows = samples.union_sources(mean, later, stats.where("statistic = 'std'").withColumn("line", F.lit(0)))
    got = scoring.mean_row(rows, name="statistic").drop("line")
    return rounded(got, *M)


@query("score_speed", with_sql("scored") + f"select loader, {rounded_sql('speed')} from scored")
def score_speed(spark, sf_dir):
    stats = _stats(spark, sf_dir)
    return rounded(stats.withColumn("speed", scoring.score_columns(stats)["speed"]).select("loader", "speed"), "speed")


INVERSE = ("efficiency", "memory", "cpu", "load_time")


@query("score_inverse", with_sql("scored") + f"select loader, {rounded_sql(*INVERSE)} from scored")
def score_inverse(spark, sf_dir):
    stats = _stats(spark, sf_dir)
    columns = scoring.score_columns(stats)
    return rounded(stats.select("loader", *[columns[s].alias(s) for s in INVERSE]), *INVERSE)


@query("score_overall5", with_sql("scored") + f"select loader, {rounded_sql('overall')} from scored")
def score_overall5(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("loader", "overall"), "overall")


@query(
    "score_overall4",
    with_sql("scored")
    + "select loader, round(greatest(0.0, least(100.0, 0.4 * speed + 0.4 * efficiency + 0.1 * memory + 0.1 * cpu)), 6) as overall from scored",
)
def score_overall4(spark, sf_dir):
    got = scoring.scores(_stats(spark, sf_dir), scoring.WEIGHTS_FOUR, clamp=True)
    return rounded(got.select("loader", "overall"), "overall")


@query(
    "leaderboard",
    with_sql("scored")
    + f"select loader, {rounded_sql(*SCORE_NAMES, 'overall')}, row_number() over (order by overall desc, loader) as rank from scored",
)
def leaderboard(spark, sf_dir):
    got = loading.ranking(V.telemetry(spark, sf_dir)).select("loader", *SCORE_NAMES, "overall", "rank")
    return rounded(got, *SCORE_NAMES, "overall")


LONG = """long as (
  select loader, metric, value, case when metric = 'images_per_sec' then -value else value end as v
  from (unpivot (select loader, images_per_sec, total_time, avg_ram, avg_cpu, avg_data_load_time from stats)
    on images_per_sec, total_time, avg_ram, avg_cpu, avg_data_load_time into name metric value value))"""


@query(
    "metric_rankings",
    with_sql("stats", more=LONG)
    + "select metric, loader, round(value, 6) as value, row_number() over (partition by metric order by v, loader) as rank from long",
)
def metric_rankings(spark, sf_dir):
    return rounded(scoring.metric_rankings(_stats(spark, sf_dir)), "value")


@query(
    "best_by_metric",
    with_sql("stats", more=LONG)
    + """select metric, loader, round(value, 6) as value from (
  select *, row_number() over (partition by metric order by v, loader) as r from long) where r = 1""",
)
def best_by_metric(spark, sf_dir):
    return rounded(scoring.best_by_metric(_stats(spark, sf_dir)), "value")


RAW = ("images_per_sec", "total_time", "avg_ram", "avg_cpu")


@query(
    "winner",
    with_sql("scored") + f"select loader, {rounded_sql('overall', *RAW)} from scored order by overall desc, loader limit 1",
)
def winner(spark, sf_dir):
    return rounded(scoring.top(_scored(spark, sf_dir), 1).select("loader", "overall", *RAW), "overall", *RAW)


@query(
    "top3",
    with_sql("scored")
    + f"""select loader, part, round(score, 6) as score
from (unpivot (select loader, {', '.join(SCORE_NAMES)} from scored order by overall desc, loader limit 3)
  on {', '.join(SCORE_NAMES)} into name part value score)""",
)
def top3(spark, sf_dir):
    got = scoring.unpivot(scoring.top(_scored(spark, sf_dir), 3), ["loader"], SCORE_NAMES, "part", "score")
    return rounded(got, "score")


@query(
    "best_marker",
    with_sql("stats", more=LONG)
    + f"""select metric, loader, round(value, 6) as value,
  case when metric <> 'avg_cpu' and v = min(v) over (partition by metric) then '{scoring.MARK}' else '' end as mark from long""",
)
def best_marker(spark, sf_dir):
    return rounded(scoring.best_marks(_stats(spark, sf_dir)), "value")


@query("efficiency_ratio", with_sql("stats") + "select loader, round(images_per_sec / total_time * 1e6, 6) as ratio from stats")
def efficiency_ratio(spark, sf_dir):
    """Images per second and second, in millionths."""
    ratio = C.rate("images_per_sec", "total_time") * 1e6
    return _stats(spark, sf_dir).select("loader", F.round(ratio, 6).alias("ratio"))


@query(
    "speedup",
    with_sql("stats", more="ranked as (select *, row_number() over (order by images_per_sec desc, loader) as r from stats)")
    + """select max(case when r = 1 then loader end) as loader, round(max(case when r = 1 then images_per_sec end), 9) as best,
  round(min(case when r > 1 then images_per_sec end), 9) as slowest,
  round(max(case when r = 1 then images_per_sec end) / min(case when r > 1 then images_per_sec end), 6) as speedup
from ranked""",
)
def speedup(spark, sf_dir):
    got = rounded(scoring.speedup(_stats(spark, sf_dir)), "best", "slowest", digits=9)
    return rounded(got, "speedup")


@query(
    "comparison_pivot",
    with_sql("stats", more=LONG)
    + """select metric, loader, round(value, 6) as value, case when metric = 'images_per_sec' then 'higher' else 'lower' end as better
from long""",
)
def comparison_pivot(spark, sf_dir):
    """One row per metric and loader, whatever loaders the data has; ``comparison_table`` is the wide form of chosen ones."""
    return rounded(scoring.comparison_cells(_stats(spark, sf_dir)), "value")


@query(
    "recommendations",
    with_sql(
        "scored",
        more="cases as ("
        + " union all ".join(f"select '{u}' as use_case, loader, {s} as score from scored" for u, s in scoring.USE_CASES)
        + ")",
    )
    + """select use_case, loader, round(score, 6) as score from (
  select *, row_number() over (partition by use_case order by score desc, loader) as r from cases) where r = 1""",
)
def recommendations(spark, sf_dir):
    return rounded(scoring.recommendations(_scored(spark, sf_dir)), "score")


@query(
    "score_breakdown",
    with_sql(
        "scored",
        more="parts as ("
        + " union all ".join(
            f"select loader, '{s}' as part, {s} as score, cast({w} as double) as weight from scored"
            for s, w in scoring.WEIGHTS_FIVE.items()
        )
        + ")",
    )
    + "select loader, part, weight, round(score, 6) as score, round(score * weight, 6) as points from parts",
)
def score_breakdown(spark, sf_dir):
    return rounded(scoring.score_breakdown(_scored(spark, sf_dir)), "score", "points")


@query(
    "lookup_join",
    with_sql("scored") + f"select loader, {rounded_sql('overall', 'total_time', 'avg_ram')}, total_images from (select loader, overall from scored) join stats using (loader)",
)
def lookup_join(spark, sf_dir):
    stats = _stats(spark, sf_dir)
    board = scoring.scores(stats).select("loader", "overall")
    got = board.join(stats.select("loader", "total_time", "avg_ram", "total_images"), "loader")
    return rounded(got, "overall", "total_time", "avg_ram")
