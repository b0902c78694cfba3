"""The report as a committed artefact: staged, counted, switched, cleaned.

A run writes its rows to a folder of its own. Only then does one row of the manifest name that folder as the month's
newest version, so a reader sees a whole run or the one before it, never a part. What a failed run leaves behind is named
nowhere and goes with the next cleaning. One writer of a month at a time; readers at any time.

    path/runs/<run>/...    rows of one run
    path/manifest/...      period, version, run, rows
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "period INT, version INT, run STRING, rows BIGINT"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Every committed version; no rows before the first commit."""
    place, files = _file_system(spark, f"{path}/manifest")
    if not files.exists(place):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def newest(spark: SparkSession, path: str, keep: int = 1) -> list:
    """The last ``keep`` versions of each month, newest first: a few rows a month."""
    rows = sorted(manifest(spark, path).collect(), key=lambda r: (r.period, -r.version))
    places: dict[int, int] = {}
    kept = []
    for row in rows:
        places[row.period] = places.get(row.period, 0) + 1
        if places[row.period] <= keep:
            kept.append(row)
    return kept


def commit_report(report: DataFrame, path: str, period: int) -> str:
    """Write a month's report, empty or not, and make it the one that is read. The name of the run.

    Rows of another month stop the run before the switch. The rows are counted in what was written.
    """
    spark, run = report.sparkSession, uuid.uuid4().hex
    folder = f"{path}/runs/{run}"
    report.write.parquet(folder)
    counts = spark.read.schema(report.schema).parquet(folder).agg(
        F.count("*").alias("rows"), F.count_if(~F.col("period").eqNullSafe(F.lit(period))).alias("foreign")
    )
    rows, foreign = counts.first()
    if foreign:
        raise ValueError(f"{foreign} rows of the report are not of {period}")
    before = [r.version for r in newest(spark, path) if r.period == period]
    entry = spark.createDataFrame([(period, max(before, default=0) + 1, run, rows)], MANIFEST)
    entry.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return run


def read_report(spark: SparkSession, path: str, period: int | None = None) -> DataFrame:
    """The newest report of a month, or of every month. Stops if rows that were committed are not there."""
    wanted = [r for r in newest(spark, path) if period in (None, r.period)]
    if not wanted:
        raise ValueError(f"no report of {period or 'any month'} in {path}")
    report = spark.read.option("mergeSchema", "true").parquet(*[f"{path}/runs/{r.run}" for r in wanted])
    found = {r["period"]: r["count"] for r in report.groupBy("period").count().collect()}  # a row a month
    for r in wanted:
        if found.get(r.period, 0) != r.rows:
            raise ValueError(f"{found.get(r.period, 0)} rows of {r.period} instead of the {r.rows} committed")
    return report


def clean_report(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove the runs that no month's last ``keep`` versions name, those of failed runs among them; how many.

    Not while a run is being written.
    """
    named = {r.run for r in newest(spark, path, keep)}
    place, files = _file_system(spark, f"{path}/runs")
    runs = [entry.getPath() for entry in files.listStatus(place)] if files.exists(place) else []
    old = [run for run in runs if run.getName() not in named]
    for run in old:
        files.delete(run, True)
    return len(old)
