"""Sinks: tables, views and reports."""

from __future__ import annotations

import json
import logging
import sys

from pyspark.sql import DataFrame, SparkSession


def save_table(df: DataFrame, name: str, path: str) -> DataFrame:
    """A table over Parquet files under `path`, replaced as a whole, and read back."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return spark.catalog.createTable(name, path, "parquet")


def save_view(df: DataFrame, name: str) -> DataFrame:
    """A lazy view of this session."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small report through Hadoop's file system layer, so any store will do."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON report; a missing file is an empty one."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return {}
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def scorecard_reports(spark: SparkSession, card: DataFrame, folder: str) -> dict:
    """Writes the one-row scorecard as scorecard.json and scorecard.md and returns it."""
    row = card.first().asDict()
    write_text(spark, json.dumps(row, indent=2), f"{folder}/scorecard.json")
    lines = [f"| {k.replace('_', ' ')} | {v:,.2f} |" if isinstance(v, float) else f"| {k.replace('_', ' ')} | {v:,} |" for k, v in row.items()]
    write_text(spark, "\n".join(["# Scorecard", "", "| Metric | Value |", "|---|---|", *lines, ""]), f"{folder}/scorecard.md")
    return row


def profile_html(spark: SparkSession, profile: DataFrame, path: str) -> None:
    """The profile (one row per column) as an HTML table."""
    write_text(spark, profile.orderBy("column_name").toPandas().to_html(index=False), path)


def log_to(name: str, path: str | None = None) -> logging.Logger:
    """A logger with time stamps, to stdout and a file of the driver."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    if not log.handlers:
        for handler in [logging.StreamHandler(sys.stdout), *([logging.FileHandler(path)] if path else [])]:
            handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
            log.addHandler(handler)
    return log
