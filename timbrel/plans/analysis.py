"""From lines to summaries: the whole chain for all logs at once."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import partial
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.config import Config
from timbrel.formats import engine
from timbrel.operators import correlation, detectors
from timbrel.operators.lines import last
from timbrel.plans import inference, summary


class Analysis(NamedTuple):
    """``summaries``: one row a log. ``events``: those analysed, kept until ``release``."""

    summaries: DataFrame
    events: DataFrame
    kept: tuple[DataFrame, ...]

    def release(self) -> None:
        for frame in self.kept:
            frame.unpersist()


def analyse(lines: DataFrame, config: Config | None = None, format_name: str | None = None, span: str | None = None, now: datetime | None = None, year: int = 2024, baselines: DataFrame | None = None, score=None) -> Analysis:
    """The analysis of ``lines`` (log_path, line_number, raw), which are read more than once. ``now``: UTC, the end of
    ``span`` and the time of signals without one. ``score``: a model instead of the lexical one (see ``summarize``)."""
    config, now = config or Config(), now or datetime.now(timezone.utc).replace(tzinfo=None)
    tables: list[DataFrame] = []
    if format_name:
        formats = lines.select("log_path").distinct().withColumn("format", F.lit(engine.named(format_name).name))
    else:
        tables.append(engine.detect(lines).persist())
        formats = engine.covered(lines, tables[0]).persist()
        tables.append(formats)
    # The detectors read the events more than once; parsing again would cost more than keeping them.
    kept = engine.read_all(lines, formats, year).persist(StorageLevel.MEMORY_AND_DISK)
    counts = kept.groupBy("log_path").agg(F.count_if(~F.col("meta")).alias("parsed_count"), F.count_if("meta").alias("_meta"))
    text = lines.groupBy("log_path").agg(F.count(F.when(F.trim("raw") != "", 1)).alias("_text"))
    events = kept.filter("NOT meta").drop("meta")
    if span:
        events = last(events, now, span)
    times = events.groupBy("log_path").agg(F.min("ts").alias("first_event"), F.max("ts").alias("last_event"))
    logs = text.join(formats, "log_path", "left").join(counts, "log_path", "left").join(times, "log_path", "left")
    parsed = F.coalesce("parsed_count", F.lit(0))
    skipped = F.greatest(F.lit(0), F.col("_text") - parsed - F.coalesce("_meta", F.lit(0)))
    logs = logs.select("log_path", F.coalesce("format", F.lit("generic")).alias("parser_format"), parsed.alias("parsed_count"), skipped.alias("skipped_count"), "first_event", "last_event")
    a = config.analysis
    found = detectors.detect(events, a.window_size_minutes, a.burst_multiplier, a.auth_failure_threshold, a.spike_factor, baselines)
    at = F.unix_micros(F.lit(now).cast("timestamp_ntz").cast("timestamp"))
    found = found.withColumns({"start": F.coalesce("start", at), "end": F.coalesce("end", at)})
    signals = correlation.correlate(correlation.merge(found), a.correlation_gap_seconds * 1_000_000)
    if score is None and config.inference.enabled:
        score = partial(inference.lexical, threshold=config.inference.threshold)
    return Analysis(summary.summarize(logs, signals, score), events, (kept, *tables))
