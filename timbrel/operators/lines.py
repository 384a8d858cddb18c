"""Line and event filters."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duration(text: str) -> timedelta:
    """A number with s, m, h or d."""
    found = re.fullmatch(r"(\d+)([smhd])", text.strip())
    if not found:
        raise ValueError(f"not a duration: {text!r}; use a number with s, m, h or d")
    return timedelta(seconds=int(found[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[found[2]])


def last(events: DataFrame, now: datetime, span: str) -> DataFrame:
    """Events of the last span before ``now`` (UTC); those without a time stay. A time with a known offset from UTC is
    compared as such, others are UTC."""
    ts = F.col("ts")
    if "extra" in events.columns:
        offset = F.try_element_at("extra", F.lit("utc_offset"))
        minutes = F.substring(offset, 2, 2).try_cast("int") * 60 + F.regexp_extract(offset, r"(\d\d)$", 1).try_cast("int")
        ts = ts - F.make_dt_interval(mins=F.coalesce(F.when(offset.startswith("-"), -minutes).otherwise(minutes), F.lit(0)))
    return events.filter(F.col("ts").isNull() | (ts >= F.lit(now - duration(span)).cast("timestamp_ntz")))


def fold(lines: DataFrame, is_event: Column, is_continuation: Column, most: int = 20) -> DataFrame:
    """Continuation lines (a traceback's) appended to the event line before them, at most ``most`` stored; other lines
    between are dropped. Adds ``folded``, the number of continuation lines."""
    order = Window.partitionBy("log_path").orderBy("line_number")
    marked = lines.withColumn("_event", is_event).withColumn("_more", ~F.col("_event") & is_continuation)
    marked = marked.withColumn("_of", F.sum(F.col("_event").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("_of > 0 AND (_event OR _more)")
    place = Window.partitionBy("log_path", "_of").orderBy("line_number")
    placed = marked.withColumn("_at", F.row_number().over(place))
    kept = F.array_sort(F.collect_list(F.when(F.col("_at") <= most + 1, F.struct("_at", "raw"))))
    out = placed.groupBy("log_path", "_of").agg(F.min("line_number").alias("line_number"), kept.alias("k"), (F.count(F.lit(1)) - 1).alias("folded"))
    return out.select("log_path", "line_number", F.array_join(F.transform("k", lambda x: x["raw"]), "\n").alias("raw"), "folded")
