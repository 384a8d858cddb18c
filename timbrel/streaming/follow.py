"""Following logs: new lines of text files become events, and sliding windows of errors become alerts.

A format is known beforehand, as a stream has no first lines to look at; formats that need earlier lines of their log are
refused. Windows are closed by the watermark: an event that comes later than ``late`` behind the newest one is dropped from
them, which is what bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from timbrel import constants as C
from timbrel.formats import engine
from timbrel.functions.severity import is_error, is_significant


def lines(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """Stream of (log_path, line_number, raw) of the text files that appear in a folder; lines have no number."""
    text = spark.readStream.format("text").option("maxFilesPerTrigger", files_at_once).load(folder)
    return text.select(F.col("_metadata.file_path").alias("log_path"), F.lit(None).cast("long").alias("line_number"), F.col("value").alias("raw"))


def events(stream: DataFrame, format_name: str, year: int = 2024) -> DataFrame:
    """Stream of events in one format."""
    fmt = engine.named(format_name)
    if fmt.carry or fmt.fold:
        raise ValueError(f"{fmt.name} needs earlier lines of its log; read it as a batch")
    return engine.parse(stream, fmt, year)


def error_windows(stream: DataFrame, window_minutes: int = 5, late: str = "10 minutes", least: int = C.MIN_BURST_EVENTS, keys: tuple[str, ...] = ("log_path",)) -> DataFrame:
    """Stream of (keys, start, end, events, errors, significant) of the sliding windows with ``least`` errors or more."""
    timed = stream.filter("ts IS NOT NULL").withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", late)
    sliding = F.window("time", f"{window_minutes} minutes", f"{window_minutes * 60 // 5} seconds")
    counts = timed.groupBy(*keys, sliding.alias("w")).agg(F.count(F.lit(1)).alias("events"), F.count_if(is_error(F.col("severity"))).alias("errors"), F.count_if(is_significant(F.col("severity"))).alias("significant"))
    return counts.filter(F.col("errors") >= least).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "errors", "significant")


def spikes(alerts: DataFrame, baselines: DataFrame, factor: float = 3.0) -> DataFrame:
    """Those of ``error_windows`` whose errors by the hour exceed the log's baseline by the factor."""
    hours = (F.unix_seconds("end") - F.unix_seconds("start")) / 3600
    known = baselines.select("log_path", F.col("avg_errors_per_hour").alias("usual"))
    return alerts.join(known, "log_path").filter(F.col("errors") / hours > F.col("usual") * factor)


def write(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream to a folder of parquet files; ``once``: what is there now, then stop."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return (writer.trigger(availableNow=True) if once else writer).start()
