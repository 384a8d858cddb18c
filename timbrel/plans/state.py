"""Baselines and run history as tables keyed by log_path, and the folder that keeps them between runs."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timbrel import constants as C
from timbrel.functions.severity import is_error
from timbrel.operators.windows import ahead, each, with_us


def metrics(events: DataFrame, window_minutes: float = C.BASELINE_WINDOW_MINUTES) -> DataFrame:
    """(log_path, avg_events_per_hour, avg_errors_per_hour, p95_burst_size) of timed events."""
    ticks = with_us(events).groupBy("log_path", "us").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_error(F.col("severity"))).alias("bad"))
    counted = each(ahead(ticks, ["n"], int(window_minutes * 60_000_000)))
    hours = F.greatest((F.max("us") - F.min("us")) / 3.6e9, F.lit(C.LEAST_HOURS))
    bad = F.coalesce(F.sum(F.when(F.col("n_forward") == F.col("f_n"), F.col("bad"))), F.lit(0))  # once for each time
    return counted.groupBy("log_path").agg((F.count(F.lit(1)) / hours).alias("avg_events_per_hour"), (bad / hours).alias("avg_errors_per_hour"), F.percentile("n_forward", 0.95).alias("p95_burst_size"))


def upsert(old: DataFrame, new: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Baselines after a run: new logs are added, known ones move by ``alpha`` towards the new figures."""
    names = ["avg_events_per_hour", "avg_errors_per_hour", "p95_burst_size"]
    a = old.select(F.col("log_path").alias("_log"), *[F.col(n).alias(f"_{n}") for n in names], "sample_count")
    joined = new.join(a, F.col("log_path") == F.col("_log"), "full_outer")

    def moved(n: str):
        return F.when(F.col("_log").isNull(), F.col(n)).when(F.col("log_path").isNull(), F.col(f"_{n}")).otherwise(alpha * F.col(n) + (1 - alpha) * F.col(f"_{n}"))

    count = F.when(F.col("_log").isNull(), F.lit(1)).when(F.col("log_path").isNull(), F.col("sample_count")).otherwise(F.col("sample_count") + 1)
    return joined.select(F.coalesce("log_path", "_log").alias("log_path"), *[moved(n).alias(n) for n in names], count.cast("long").alias("sample_count"))


def history(summaries: DataFrame, ran_at: datetime, elapsed: float = 0.0) -> DataFrame:
    """Rows to append to the run history; signal_count is the number of findings, as shown."""
    known = set(summaries.columns)
    format_, parsed, skipped = (F.col(c) if c in known else F.lit(d) for c, d in (("parser_format", "unknown"), ("parsed_count", 0), ("skipped_count", 0)))
    return summaries.select(F.uuid().alias("id"), "log_path", F.lit(ran_at).cast("timestamp").alias("ran_at"), format_.alias("parser_format"), parsed.cast("long").alias("parsed_count"), skipped.cast("long").alias("skipped_count"), F.size("findings").alias("signal_count"), F.lit(elapsed).alias("elapsed_seconds"), F.col("level").alias("incident_level"), "category", "confidence", F.to_json(F.struct(*summaries.columns)).alias("summary_json"))


def recent(runs: DataFrame, most: int = 10) -> DataFrame:
    """The latest runs of each log."""
    order = Window.partitionBy("log_path").orderBy(F.col("ran_at").desc(), F.col("id").desc())
    return runs.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most).drop("_n")


class StateError(RuntimeError):
    """A state folder of another version."""


class Store:
    """A folder with the tables ``baselines`` and ``runs``. Baselines are written whole as a new version, which counts once
    Spark has marked it as complete; a run that fails halfway leaves the version before. Runs are appended."""

    VERSION = 1
    SCHEMAS = {
        "baselines": "log_path string, parser_format string, avg_events_per_hour double, avg_errors_per_hour double, p95_burst_size double, sample_count long, last_updated timestamp",
        "runs": "id string, log_path string, ran_at timestamp, parser_format string, parsed_count long, skipped_count long, signal_count int, elapsed_seconds double, incident_level string, category string, confidence double, summary_json string",
    }

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path if "://" in path else "file://" + str(Path(path).expanduser().resolve())
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._place = lambda name: hadoop.Path(f"{self.path}/{name}")
        self._files = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        marks = [m for m in self._names("") if m.startswith("schema-")]
        if not marks:
            self._files.mkdirs(self._place(f"schema-{self.VERSION}"))
        elif marks != [f"schema-{self.VERSION}"]:
            raise StateError(f"{self.path} has {', '.join(marks)}; this version reads schema-{self.VERSION}")

    def _names(self, name: str) -> list[str]:
        at = self._place(name or ".")
        return sorted(x.getPath().getName() for x in self._files.listStatus(at)) if self._files.exists(at) else []

    def _versions(self) -> list[str]:
        return [v for v in self._names("baselines") if "_SUCCESS" in self._names(f"baselines/{v}")]

    def _read(self, name: str, at: str | None) -> DataFrame:
        if at is None:
            return self.spark.createDataFrame([], self.SCHEMAS[name])
        return self.spark.read.schema(self.SCHEMAS[name]).parquet(f"{self.path}/{at}")

    def baselines(self) -> DataFrame:
        found = self._versions()
        return self._read("baselines", f"baselines/{found[-1]}" if found else None)

    def runs(self) -> DataFrame:
        return self._read("runs", "runs" if self._names("runs") else None)

    def update(self, new: DataFrame, formats: DataFrame, alpha: float, now: datetime) -> None:
        """Move the baselines of the logs in ``new`` (of ``metrics``); ``formats``: (log_path, parser_format)."""
        found, old = self._versions(), self.baselines()
        moved = upsert(old, new, alpha)
        kinds = formats.select(F.col("log_path").alias("_f"), F.col("parser_format").alias("_kind"))
        before = old.select(F.col("log_path").alias("_b"), F.col("parser_format").alias("_old"), F.col("last_updated").alias("_when"))
        rows = moved.join(kinds, F.col("log_path") == F.col("_f"), "left").join(before, F.col("log_path") == F.col("_b"), "left")
        names = ["avg_events_per_hour", "avg_errors_per_hour", "p95_burst_size", "sample_count"]
        fresh = rows.join(new.select(F.col("log_path").alias("_n")), F.col("log_path") == F.col("_n"), "left")
        when = F.when(F.col("_n").isNotNull(), F.lit(now).cast("timestamp")).otherwise(F.col("_when"))
        out = fresh.select("log_path", F.coalesce(F.when(F.col("_n").isNotNull(), F.col("_kind")), "_old", "_kind", F.lit("unknown")).alias("parser_format"), *names, when.alias("last_updated"))
        version = f"v{int(found[-1][1:]) + 1 if found else 1:09d}"
        out.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/baselines/{version}")
        for gone in found[:-1]:
            self._files.delete(self._place(f"baselines/{gone}"), True)

    def append(self, runs: DataFrame) -> None:
        runs.coalesce(1).write.mode("append").parquet(f"{self.path}/runs")
