"""Scanning of files as they arrive: the batch pipeline is stateless, so a stream runs it unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.api import scan_table


def scan_stream(spark: SparkSession, folder: str, schema: str, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """Task markers of parquet tables of files (path, content and more) that arrive in ``folder``."""
    return scan_table(spark.readStream.schema(schema).parquet(folder), keep=keep, **options)


def counts_by_window(tasks: DataFrame, time_col: str = "committed_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Markers by type and time window; rows later than ``late`` behind the newest are left out."""
    return tasks.withWatermark(time_col, late).groupBy(F.window(time_col, window), "type").agg(F.count(F.lit(1)).alias("n"))
