"""Run report files: runs, a blank line, then mean and std rows.

Reports are small files (one row per run).  Each is read whole, because the
order of its lines matters; many reports are read side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardflow.functions.columns import safe_double
from shardflow.operators.telemetry import RUN_METRICS


def report_lines(runs: DataFrame, stats: DataFrame, metrics: Sequence[str] = RUN_METRICS, delimiter: str = ",") -> DataFrame:
    """``loader, section, run_id, line``: the text of one report per loader.

    Section 0 is the header, 1 the runs, 2 the blank line, 3 the statistics
    header and 4 the statistics.
    """
    numbers = [F.coalesce(F.col(m).cast("string"), F.lit("")) for m in metrics]
    head = delimiter.join(metrics)
    rows = runs.select(
        "loader", F.lit(1).alias("section"), F.col("run_id").cast("bigint").alias("run_id"),
        F.concat_ws(delimiter, F.col("run_id").cast("string"), *numbers).alias("line"),
    )
    ends = stats.select(
        "loader", F.lit(4).alias("section"), F.when(F.col("statistic") == "mean", 0).otherwise(1).cast("bigint"),
        F.concat_ws(delimiter, "statistic", *numbers),
    )
    frame = F.array(
        F.struct(F.lit(0).alias("section"), F.lit(f"run_id{delimiter}{head}").alias("line")),
        F.struct(F.lit(2).alias("section"), F.lit("").alias("line")),
        F.struct(F.lit(3).alias("section"), F.lit(f"statistic{delimiter}{head}").alias("line")),
    )
    fixed = stats.where(F.col("statistic") == "mean").select("loader", F.inline(frame))
    fixed = fixed.select("loader", "section", F.lit(0).cast("bigint"), "line")
    return rows.union(ends).union(fixed)


def write_reports(
    runs: DataFrame, stats: DataFrame, path: str, metrics: Sequence[str] = RUN_METRICS, delimiter: str = ","
) -> None:
    """One text file per loader, in the folder ``loader=<name>``."""
    (
        report_lines(runs, stats, metrics, delimiter)
        .repartition("loader")
        .sortWithinPartitions("loader", "section", "run_id")
        .select("loader", "line")
        .write.partitionBy("loader")
        .text(path)
    )


def loader_of(file: str = "file") -> Column:
    """The loader of a report written by ``write_reports``, from the file's path.

    The folder's name escapes some letters and the path's URI escapes it again.
    """
    name = F.regexp_extract(file, "loader=([^/]*)/", 1)
    for _ in range(2):
        name = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    return F.when(name != "__HIVE_DEFAULT_PARTITION__", name)


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, line, text, delimiter`` for every line of every report."""
    whole = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    whole = whole.select(F.col("_metadata.file_path").alias("file"), "value")
    # A file is tab-separated if its first line holds a tab.
    first = F.substring_index("value", "\n", 1)
    delimiter = F.when(F.contains(first, F.lit("\t")), "\t").otherwise(",")
    return whole.select(
        "file", delimiter.alias("delimiter"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text")
    )


def _cells(text: str, delimiter: str) -> Column:
    return F.transform(F.call_function("split", F.col(text), F.concat(F.lit("\\"), F.col(delimiter))), lambda cell: F.trim(cell))


def _row_map(header: Column, cells: Column) -> Column:
    """Header to cell; missing cells are null and cells without a header are left out."""
    n = F.size(header)
    padded = F.transform(F.sequence(F.lit(1), n), lambda k: F.try_element_at(cells, k))
    pairs = F.arrays_zip(header.alias("k"), padded.alias("v"))
    return F.map_from_entries(F.filter(pairs, lambda p: p["k"] != ""))


def read_reports(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file, line, run_id, cells``: all rows below the header line, blank ones left out.

    The first line of a file is its header, and ``cells`` maps header names to
    texts; the second header of the statistics block is a row like the others.
    """
    lines = _lines(spark, path).withColumn("parts", _cells("text", "delimiter"))
    lines = lines.where(F.exists("parts", lambda p: p != ""))
    first = Window.partitionBy("file").orderBy("line")
    header = F.first("parts").over(first)
    rows = lines.withColumn("cells", _row_map(header, F.col("parts"))).withColumn("nth", F.row_number().over(first))
    return rows.where("nth > 1").select(
        "file", F.col("line").cast("bigint").alias("line"), F.col("parts")[0].alias("run_id"), "cells"
    )


def read_sections(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Reports of several blocks: ``file, block, title, kind, name, cells``.

    A block starts with an optional title row, then a header (``run_id``) with
    its runs, then a header (``statistic``) with mean and std.  ``kind`` is
    ``run`` or ``statistic``.
    """
    lines = _lines(spark, path).withColumn("parts", _cells("text", "delimiter"))
    lines = lines.where(F.exists("parts", lambda p: p != ""))
    name = F.col("parts")[0]
    kind = F.when(name == "run_id", "run").when(name == "statistic", "statistic")
    title = F.when(name == "", F.array_join(F.filter("parts", lambda p: p != ""), " "))
    upto = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.select("*", name.alias("name"), kind.alias("head"), title.alias("head_title")).select(
        "*",
        F.count(F.when(F.col("head") == "run", 1)).over(upto).alias("block"),
        F.last("head", True).over(upto).alias("kind"),
        F.last(F.when(F.col("head").isNotNull(), F.col("parts")), True).over(upto).alias("header"),
        F.last("head_title", True).over(upto).alias("title"),
    )
    rows = marked.where(F.col("head").isNull() & F.col("head_title").isNull() & F.col("header").isNotNull())
    return rows.select(
        "file", "block", "title", "kind", "name", _row_map(F.col("header"), F.col("parts")).alias("cells")
    )


def metric_columns(rows: DataFrame, keep: Sequence[str], metrics: Sequence[str] = RUN_METRICS) -> DataFrame:
    """Metrics as numbers; a text that is no number or a missing cell is null."""
    return rows.select(*keep, *[safe_double(F.try_element_at("cells", F.lit(m))).alias(m) for m in metrics])


def complete_rows(rows: DataFrame, metrics: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that hold all needed numbers, and the others with the names of what is missing."""
    missing = F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in metrics]))
    checked = rows.withColumn("missing", missing)
    good = checked.where(F.size("missing") == 0).drop("missing")
    return good, checked.where(F.size("missing") > 0).withColumn("missing", F.array_join("missing", ","))
