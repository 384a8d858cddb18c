"""Merging and ordering signals. A log has tens of signals at most, so the order-dependent merge runs by log in Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbrel.constants import MERGED_SAMPLES, SEVERITY_ORDER
from timbrel.functions.severity import rank

_EVENT = "struct<line_number:bigint,message:string,severity:string,ts:timestamp_ntz>"
_SCHEMA = f"log_path string, detector_seq int, kind string, start bigint, end bigint, event_count bigint, baseline_count double, severity string, samples array<{_EVENT}>"


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    kept: list[dict] = []
    for new in group.sort_values(["detector_seq", "start"], kind="stable").to_dict("records"):
        new["samples"] = list(new["samples"])
        for old in kept:
            if old["kind"] != new["kind"] or pd.isna(old["start"]) != pd.isna(new["start"]):
                continue
            if pd.isna(old["start"]) or (old["start"] <= new["end"] and new["start"] <= old["end"]):
                if new["event_count"] > old["event_count"]:
                    old["baseline_count"] = new["baseline_count"]
                if not pd.isna(old["start"]):
                    old["start"], old["end"] = min(old["start"], new["start"]), max(old["end"], new["end"])
                old["event_count"] = max(old["event_count"], new["event_count"])
                old["severity"] = min(old["severity"], new["severity"], key=SEVERITY_ORDER.index)
                seen = {(s["line_number"], s["message"]): s for s in reversed(old["samples"] + new["samples"])}
                old["samples"] = list(reversed(seen.values()))[:MERGED_SAMPLES]
                break
        else:
            kept.append(new)
    out = pd.DataFrame(kept, columns=group.columns)
    for c in ("start", "end"):
        out[c] = out[c].astype("Int64")
    return out


def merge(signals: DataFrame) -> DataFrame:
    """Each signal goes into the first kept one of its kind and log whose grown window overlaps it."""
    return signals.groupBy("log_path").applyInPandas(_merge, _SCHEMA)


def correlate(signals: DataFrame, gap_us: int) -> DataFrame:
    """Signals with ``group_id``, ``group_size`` and ``position`` (from 1) in the final order of their log: severity, then
    members of larger groups first, then time. A group ends where the next start is more than the gap behind all ends."""
    order = Window.partitionBy("log_path").orderBy("start", "detector_seq")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col("start") - reach > gap_us), 1).otherwise(0)
    grouped = signals.withColumn("_new", opened).withColumn("group_id", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")
    sized = grouped.withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy("log_path", "group_id")).cast("long"))
    last: list[Column] = [rank(F.col("severity")), (F.col("group_size") == 1).cast("int"), F.col("start"), F.col("detector_seq")]
    return sized.withColumn("position", F.row_number().over(Window.partitionBy("log_path").orderBy(*last)).cast("long"))
