import pytest
from pyspark.sql import functions as F

from shardflow.operators import scoring, telemetry

# Invented mean rows: time, rate, load time, cpu, ram.
STATS = [
    ("north", 100.0, 40.0, 0.25, 50.0, 4.0),
    ("east", 80.0, 50.0, 1.0, 40.0, 2.0),
    ("south", 50.0, 80.0, 2.0, 25.0, 8.0),
    ("west", 125.0, 32.0, 0.5, 20.0, 1.0),
    ("centre", 200.0, 20.0, 4.0, 10.0, 16.0),
]
FIVE, FOUR = (0.35, 0.35, 0.15, 0.10, 0.05), (0.4, 0.4, 0.1, 0.1)


def by_hand(row):
    """Scores of one loader: what is best in a column has 100."""
    _, time, rate, load, cpu, ram = row
    best = [min(r[k] for r in STATS) for k in range(1, 6)]
    speed = 100 * rate / max(r[2] for r in STATS)
    return speed, 100 * best[0] / time, 100 * best[4] / ram, 100 * best[3] / cpu, 100 * best[2] / load


OVERALL = {r[0]: sum(w * s for w, s in zip(FIVE, by_hand(r))) for r in STATS}
RANKED = sorted(OVERALL, key=OVERALL.get, reverse=True)
NAMES = "loader string, total_time double, images_per_sec double, avg_data_load_time double, avg_cpu double, avg_ram double"


@pytest.fixture(scope="module")
def stats(spark):
    return spark.createDataFrame(STATS, NAMES).repartition(3)


def test_scores_against_the_formula(stats):
    five = {r.loader: r for r in scoring.scores(stats).collect()}
    four = {r.loader: r for r in scoring.scores(stats, scoring.WEIGHTS_FOUR, clamp=True).collect()}
    for row in STATS:
        want, r = by_hand(row), five[row[0]]
        assert (r.speed, r.efficiency, r.memory, r.cpu, r.load_time) == pytest.approx(want)
        assert r.overall == pytest.approx(OVERALL[row[0]])
        assert four[row[0]].overall == pytest.approx(sum(w * s for w, s in zip(FOUR, want)))


def test_leaderboard_and_top(stats):
    scored = scoring.scores(stats)
    board = scoring.leaderboard(scored).orderBy("rank").collect()
    assert [r.loader for r in board] == RANKED and [r["rank"] for r in board] == [1, 2, 3, 4, 5]
    assert [r.loader for r in scoring.top(scored, 3).collect()] == RANKED[:3]


def test_best_ones(stats):
    best = {r.metric: r.loader for r in scoring.best_by_metric(stats).collect()}
    assert best == {
        "images_per_sec": "south", "total_time": "south", "avg_ram": "west", "avg_cpu": "centre", "avg_data_load_time": "north",
    }
    cases = {r.use_case: r.loader for r in scoring.recommendations(scoring.scores(stats)).collect()}
    assert cases == {"throughput": "south", "memory": "west", "balanced": RANKED[0], "cpu": "centre"}
    got = scoring.speedup(stats).first()
    assert got.loader == "south" and got.speedup == 4.0


def test_marks_are_on_equal_values_and_not_on_cpu(stats, spark):
    twin = stats.union(spark.createDataFrame([("zero", *STATS[3][1:])], NAMES))
    marked = {(r.metric, r.loader) for r in scoring.best_marks(twin).collect() if r.mark}
    assert ("avg_ram", "west") in marked and ("avg_ram", "zero") in marked
    assert not any(m == "avg_cpu" for m, _ in marked) and len(marked) == 5


def test_ties_go_to_the_first(spark):
    rows = [("b", 1.0, 1.0, 1.0, 1.0, 1.0), ("a", 1.0, 1.0, 1.0, 1.0, 1.0), ("c", 2.0, 0.5, 2.0, 2.0, 2.0)]
    stats = spark.createDataFrame(rows, NAMES).withColumn("place", F.when(F.col("loader") == "b", 0).otherwise(1))
    assert {r.loader for r in scoring.best_by_metric(stats).collect()} == {"a"}
    assert {r.loader for r in scoring.best_by_metric(stats, "place").collect()} == {"b"}
    ranks = scoring.metric_rankings(stats, "place").where("metric = 'avg_ram'").orderBy("rank").collect()
    assert [r.loader for r in ranks] == ["b", "a", "c"]
    got = scoring.speedup(stats).first()
    assert (got.loader, got.slowest, got.speedup) == ("a", 0.5, 2.0)


def test_zero_metrics_score_zero(spark):
    stats = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0.0, 0.0), ("b", 1.0, 0.0, 1.0, 1.0, 1.0)], NAMES)
    got = {r.loader: r for r in scoring.scores(stats).collect()}
    assert got["a"].overall == 0.0 and got["b"].speed == 0.0 and got["b"].efficiency == 0.0


def test_table_and_breakdown(stats):
    table = {r.metric: r for r in scoring.comparison_table(stats, ["north", "south"]).collect()}
    assert table["images_per_sec"].south == 80.0 and table["images_per_sec"].better == "higher"
    assert table["avg_cpu"].north == 50.0 and table["avg_cpu"].better == "lower"
    cells = {(r.metric, r.loader): r.value for r in scoring.comparison_cells(stats).collect()}
    assert len(cells) == 25 and cells["avg_ram", "centre"] == 16.0
    parts = scoring.score_breakdown(scoring.scores(stats)).where("loader = 'west'").collect()
    assert sum(p.points for p in parts) == pytest.approx(OVERALL["west"])


# Invented runs.
RUNS = [
    ("north", 1, 10.0, 600, 60.0, 0.5, 20.0, 1.0),
    ("north", 2, 20.0, 600, 30.0, 0.25, 30.0, 2.0),
    ("north", 3, 30.0, 600, 20.0, 0.75, 10.0, 3.0),
    ("lone", 1, 5.0, 10, 2.0, 0.1, 1.0, 1.0),
]


def test_mean_and_population_deviation(spark):
    names = ", ".join(f"{m} {'bigint' if m == 'total_images' else 'double'}" for m in telemetry.RUN_METRICS)
    runs = spark.createDataFrame(RUNS, f"loader string, run_id int, {names}")
    got = {(r.loader, r.statistic): r for r in telemetry.run_statistics(runs).collect()}
    columns = list(zip(*[r[2:] for r in RUNS[:3]]))
    means = [sum(c) / 3 for c in columns]
    assert got["north", "mean"][2:] == pytest.approx(means)
    assert got["north", "std"][2:] == pytest.approx([(sum((x - m) ** 2 for x in c) / 3) ** 0.5 for c, m in zip(columns, means)])
    assert got["lone", "std"][2:] == (0.0,) * 6


def test_mean_row_choice(spark):
    rows = [("a", 0, "1", 1.0), ("a", 3, " Mean", 2.0), ("a", 4, "mean", 3.0), ("b", 1, "average", 4.0), ("c", 1, "std", 5.0)]
    df = spark.createDataFrame(rows, "loader string, line int, run_id string, v double")
    assert {r.loader: r.v for r in scoring.mean_row(df).collect()} == {"a": 2.0, "b": 4.0}
    exact = scoring.mean_row(df, names=("mean",), ignore_case=False)
    assert {r.loader: r.v for r in exact.collect()} == {"a": 3.0}
