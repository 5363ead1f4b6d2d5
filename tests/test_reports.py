import os

import pytest
from pyspark.sql import functions as F

from shardflow.operators import scoring, telemetry
from shardflow.sources import reports

# All values, titles and counts here are invented.
COMMA = """run_id,total_time,total_images,images_per_sec,avg_data_load_time,avg_cpu,avg_ram
1,12.5,300,24.0,0.75,33.25,2.5

statistic,total_time,total_images,images_per_sec,avg_data_load_time,avg_cpu,avg_ram
mean,12.5,300.0,24.0,0.75,33.25,2.5
std,0.0,0.0,0.0,0.0,0.0,0.0
"""
TAB = """run_id\ttotal_time\ttotal_images\timages_per_sec\tavg_data_load_time\tavg_cpu\tavg_ram\tavg_gpu_util
1\t8.0\t640\t80.0\t0.25\t11.5\t3.5\t0.125
2\t10.0\t640\tn/a\t0.5\t12.5\t4.5

statistic\ttotal_time\ttotal_images\timages_per_sec\tavg_data_load_time\tavg_cpu\tavg_ram\tavg_gpu_util
Average\t9.0\t640\t72.0\t0.375\t12.0\t4.0\t0.0625
"""
SECTIONS = """,,,red fish,,,,
run_id,total_time,total_images,images_per_sec,avg_data_load_time,avg_cpu,avg_ram,avg_gpu_util
1,4.0,48,12.0,0.5,7.0,1.5,0.25
2,6.0,48,8.0,0.25,9.0,2.5,0.75
,,,,,,,
statistic,total_time,total_images,images_per_sec,avg_data_load_time,avg_cpu,avg_ram,avg_gpu_util
mean,5.0,48,10.0,0.375,8.0,2.0,0.5
std,1.0,0,2.0,0.125,1.0,0.5,0.25
,,,,,,,
,,,,,,,
,,,blue fish,,,,
,,,,,,,
run_id,total_time,total_images,images_per_sec,avg_data_load_time,avg_cpu,avg_ram,
1,20.0,100,5.0,0.125,40.0,0.5,
,,,,,,,
,,,,,,,
,,,old fish (one run),,,,
run_id,total_time,total_images,images_per_sec,avg_data_load_time,avg_cpu,avg_ram,
1,50.0,100,2.0,0.625,20.0,0.5,
"""


@pytest.fixture()
def folder(tmp_path):
    for name, text in (("comma.csv", COMMA), ("tab.csv", TAB), ("crlf.csv", COMMA.replace("\n", "\r\n"))):
        (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path)


def named(df):
    return df.withColumn("file", F.element_at(F.split("file", "/"), -1))


def test_delimiter_is_found_per_file(spark, folder):
    rows = named(reports.read_reports(spark, folder))
    got = {(r.file, r.run_id): r for r in reports.metric_columns(rows, ["file", "run_id"]).collect()}
    assert set(k for f, k in got if f == "comma.csv") == {"1", "statistic", "mean", "std"}
    assert got["comma.csv", "1"].avg_cpu == 33.25 and got["crlf.csv", "mean"].avg_ram == 2.5
    assert got["tab.csv", "1"].images_per_sec == 80.0
    assert got["tab.csv", "2"].images_per_sec is None and got["comma.csv", "statistic"].total_time is None


def test_missing_cells_are_null(spark, folder):
    cells = {(r.file, r.run_id): r.cells for r in named(reports.read_reports(spark, folder)).collect()}
    assert cells["tab.csv", "2"]["avg_gpu_util"] is None and cells["tab.csv", "2"]["images_per_sec"] == "n/a"
    assert cells["tab.csv", "1"]["avg_gpu_util"] == "0.125"


def test_mean_rows_of_files(spark, folder):
    rows = named(reports.read_reports(spark, folder))
    got = reports.metric_columns(scoring.mean_row(rows, by="file"), ["file", "run_id"])
    assert {r.file: r.total_time for r in got.collect()} == {
        "comma.csv": 12.5, "crlf.csv": 12.5, "tab.csv": 9.0,
    }
    good, bad = reports.complete_rows(reports.metric_columns(rows, ["file", "run_id"]), ["total_time", "images_per_sec"])
    assert {(r.file, r.run_id): r.missing for r in bad.collect()}["tab.csv", "2"] == "images_per_sec"
    assert good.where("file = 'tab.csv'").count() == 2


def test_sections(spark, tmp_path):
    (tmp_path / "s.csv").write_text(SECTIONS)
    rows = reports.read_sections(spark, str(tmp_path)).collect()
    got = {(r.block, r.kind, r.name): (r.title, r.cells["total_time"]) for r in rows}
    assert got == {
        (1, "run", "1"): ("red fish", "4.0"), (1, "run", "2"): ("red fish", "6.0"),
        (1, "statistic", "mean"): ("red fish", "5.0"), (1, "statistic", "std"): ("red fish", "1.0"),
        (2, "run", "1"): ("blue fish", "20.0"), (3, "run", "1"): ("old fish (one run)", "50.0"),
    }
    assert rows[0].cells.keys() >= {"avg_gpu_util"}


def test_written_report_has_the_known_layout(spark, tmp_path):
    names = ", ".join(f"{m} double" for m in telemetry.RUN_METRICS)
    runs = spark.createDataFrame([("a", 2, 2.0, 10.0, 5.0, 0.1, 1.0, 1.0), ("a", 1, 4.0, 10.0, 2.5, 0.3, 3.0, 1.0)], f"loader string, run_id int, {names}")
    reports.write_reports(runs, telemetry.run_statistics(runs), str(tmp_path / "out"))
    folder = tmp_path / "out" / "loader=a"
    (name,) = [n for n in os.listdir(folder) if n.startswith("part-")]
    assert (folder / name).read_text().splitlines() == [
        "run_id,total_time,total_images,images_per_sec,avg_data_load_time,avg_cpu,avg_ram",
        "1,4.0,10.0,2.5,0.3,3.0,1.0",
        "2,2.0,10.0,5.0,0.1,1.0,1.0",
        "",
        "statistic,total_time,total_images,images_per_sec,avg_data_load_time,avg_cpu,avg_ram",
        "mean,3.0,10.0,3.75,0.2,2.0,1.0",
        "std,1.0,0.0,1.25,0.09999999999999999,1.0,0.0",
    ]


# Invented: images, seconds, and a stated rate that does not follow from them.
STATED = [(900, 30.0, 35.0), (900, 45.0, 10.0)]


def test_stated_rates_can_be_checked(spark):
    from shardflow.functions.columns import rate

    df = spark.createDataFrame(STATED, "n bigint, t double, stated double").withColumn("rate", rate("n", "t"))
    assert [r.rate for r in df.collect()] == [30.0, 20.0]
    assert df.where(F.abs(F.col("rate") - F.col("stated")) > 1).count() == 2
