"""Forward time windows over the events of each log.

Events are counted by time first, so a burst of one second is one row. A window over a whole log would be one task for each
log, so times are dealt to buckets as long as the window: a bucket has its own times, those of the next bucket, and a probe
at the end of each of its own windows. Running sums then give each window's count as a difference: the work grows with
n log n, not with the events that a window holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbrel.functions.severity import is_significant


def micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def with_us(events: DataFrame) -> DataFrame:
    """Timed events with ``us``, microseconds of the wall clock."""
    return events.filter("ts IS NOT NULL").withColumn("us", micros())


def home(us: str, length: int) -> Column:
    """The number of the bucket of a time."""
    return F.expr(f"({us} - pmod({us}, {length})) div {length}")


def ahead(ticks: DataFrame, names: list[str], window_us: int) -> DataFrame:
    """``ticks`` (log_path, us, counts of ``names``; one row a time) that have a time, with ``bucket`` and for each count its
    sum ``f_<name>`` over the times from this one to the window's closed end."""
    dealt = ticks.filter("us IS NOT NULL").withColumn("bucket", home("us", window_us))
    places = [F.struct((F.col("bucket") - back).alias("_bucket"), (F.col("us") + more).alias("_at"), F.lit(kind).alias("_kind")) for back, more, kind in ((0, 0, 0), (1, 0, 1), (0, window_us, 2))]
    dealt = dealt.select("*", F.inline(F.array(*places)))
    so_far = Window.partitionBy("log_path", "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(F.when(F.col("_kind") < 2, F.col(n)).otherwise(0)).over(so_far).alias(f"_s_{n}") for n in names]
    own = Window.partitionBy("log_path", "_bucket", "us").orderBy("_kind")
    both = dealt.select("*", *sums).filter("_kind != 1")
    found = both.select(*ticks.columns, "bucket", "_kind", *[(F.lead(f"_s_{n}").over(own) - F.col(f"_s_{n}") + F.col(n)).alias(f"f_{n}") for n in names])
    return found.filter("_kind = 0").drop("_kind")


def each(found: DataFrame) -> DataFrame:
    """A row for each event of ``ahead``, with ``n_forward``: those after it at its own time count, those before don't."""
    return found.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("n_forward", F.col("f_n") - F.col("_turn") + 1).drop("_turn")


def ticks(timed: DataFrame) -> DataFrame:
    """(log_path, us, n, sig): events and significant ones at each time."""
    return timed.groupBy("log_path", "us").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_significant(F.col("severity"))).alias("sig"))


def forward_counts(timed: DataFrame, window_us: int) -> DataFrame:
    """``timed`` with ``n_forward``, the events from this one (in order of time and line) to the window's closed end, and
    ``n_significant``, warnings or worse from this time (ties included) to there."""
    found = ahead(ticks(timed), ["n", "sig"], window_us).select("log_path", "us", "f_n", F.col("f_sig").alias("n_significant"))
    tie = Window.partitionBy("log_path", "us").orderBy("line_number")
    return timed.join(found, ["log_path", "us"]).withColumn("n_forward", F.col("f_n") - F.row_number().over(tie) + 1).select(*timed.columns, "n_forward", "n_significant")
