"""Progress of a run from its growing log: the streaming counterpart of polling it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetally.sources.pages import TIMING


def stream_timing(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Records of new log files as they appear."""
    raw = spark.readStream.schema(TIMING).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return raw.select("page", F.coalesce("secs", "seconds").alias("secs"), "chars", "error", "cost_usd", F.col("_metadata.file_modification_time").alias("written"))


def progress(timing: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Pages, failures, seconds and cost for each ten minutes; records later than ``lateness`` are dropped."""
    at = F.window("written", "10 minutes")
    seen = timing.withWatermark("written", lateness).groupBy(at)
    return seen.agg(F.count(F.lit(1)).alias("pages"), F.count_if("error").alias("failed"), F.sum("secs").alias("secs"), F.sum("cost_usd").alias("cost"))


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Activity sessions of a stream (or a table): a gap closes one."""
    return events.withWatermark(ts, lateness).groupBy(key, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"))
