"""Detectors: signals (log_path, detector_seq, kind, start, end, event_count, baseline_count, severity, samples) of events.
Times are microseconds; a signal of untimed events has null times.

All detectors share three steps. Events are counted by log and time, with a count for each detector's kind of event. Forward
windows over those counts and sums by log give spans: for each signal its log, its kind of event and its time range. Events
meet the spans in one join, which gives all sums and the first events as samples. Nothing is sorted by log: counts by time
are dealt to buckets, and the number of a run of dense windows is carried from bucket to bucket by its sum alone.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbrel import constants as C
from timbrel.functions.severity import any_phrase, is_error, is_significant, rank
from timbrel.operators.windows import ahead, each, home, micros

SIGNAL = ["log_path", "detector_seq", "kind", "start", "end", "event_count", "baseline_count", "severity", "samples"]

BURSTS = 1
#: Detectors of the densest window, and of all events of a kind: kind and severity by sequence number.
CLUSTERS = {0: ("error_burst", "error"), 2: ("auth_failure_cluster", "warning"), 6: ("firewall_block_cluster", "warning"), 7: ("proxy_denial_cluster", "warning"), 9: ("auth_failure_cluster", "warning")}
OCCURRENCES = {3: ("oom_event", "critical"), 4: ("service_crash", "error"), 5: ("disk_full", "critical"), 8: ("tunnel_anomaly", "warning"), 10: ("error_burst", "warning")}
ALL = (BURSTS, *CLUSTERS, *OCCURRENCES)

_SPAN = "struct<seq:int,kind:string,severity:string,low:bigint,high:bigint,first:bigint,last:bigint,base:double,ordered:boolean>"


def _flags(wanted: set[int]) -> dict[str, Column]:
    """For each detector, is an event of its kind?"""
    low = F.lower(F.coalesce("message", F.lit("")))
    squid = F.col("is_squid")
    code = F.split(F.coalesce("result_code", F.lit("")), "/")[0]
    kinds = {
        0: lambda: is_error(F.col("severity")),
        2: lambda: any_phrase(low, C.AUTH_PHRASES),
        3: lambda: any_phrase(low, C.OOM_PHRASES),
        4: lambda: any_phrase(low, C.CRASH_PHRASES) | (any_phrase(low, C.WEAK_CRASH_PHRASES) & is_significant(F.col("severity"))),
        5: lambda: any_phrase(low, C.DISK_PHRASES),
        6: lambda: F.col("source").isin(C.FIREWALL_SOURCES) & F.lower("action").isin(C.BLOCK_ACTIONS),
        7: lambda: squid & (F.col("result_code").contains("DENIED") | (F.col("http_status") == 403)),
        8: lambda: squid & (F.upper("method") == "CONNECT") & F.col("connect_port").isNotNull() & ~F.col("connect_port").isin(C.SAFE_PORTS),
        9: lambda: squid & (F.col("http_status") == 407),
        10: lambda: squid & (code == "TCP_MISS"),
    }
    out = {f"k{i}": make() for i, make in kinds.items() if i in wanted}
    if 10 in wanted:
        out |= {"squid": squid, "cached": squid & code.isin(C.CACHEABLE_CODES)}
    return {name: F.coalesce(flag, F.lit(False)) for name, flag in out.items()}


def _span(seq: int, kind: str, severity: str, low=None, high=None, first=None, last=None, base=None, ordered: bool = True) -> Column:
    cells = [F.lit(seq), F.lit(kind), F.lit(severity), *[F.lit(None).cast("long") if x is None else x for x in (low, high, first, last)], F.lit(None).cast("double") if base is None else base, F.lit(ordered)]
    return F.struct(*cells).cast(_SPAN)


def _fixed(logs: DataFrame, wanted: set[int], window: int, threshold: int, factor: float, known: bool) -> DataFrame:
    """(log_path, span) of all detectors but the burst regions, from one row for each log."""
    found: list[Column] = []
    for i in sorted(wanted - {BURSTS}):
        if i in OCCURRENCES:
            enough = F.col(f"all_k{i}") > 0
            if i == 10:
                enough &= (F.col("all_squid") >= C.BYPASS_EVENTS) & (F.col("all_cached") > 0) & (F.col("all_k10") / F.col("all_squid") >= C.BYPASS_SHARE)
            found.append(F.when(enough, _span(i, *OCCURRENCES[i], ordered=False)))
            continue
        least = C.MIN_BURST_EVENTS if i == 0 else threshold
        best = F.col(f"best_k{i}")
        bare = (F.col(f"all_k{i}") >= least) & (F.col("timed" if i == 0 else f"timed_k{i}") == 0)
        if i == 0:
            bare &= F.col("all_k0") >= C.UNTIMED_SHARE * F.col("all_n")
        span = F.when(best["n"] >= least, _span(i, *CLUSTERS[i], low=-best["us"], high=window - best["us"])).when(bare, _span(i, *CLUSTERS[i], ordered=False))
        if i == 0 and known:
            hours = F.greatest((F.col("t1") - F.col("t0")) / 3.6e9, F.lit(C.LEAST_HOURS))
            risen = (F.col("timed_k0") >= C.MIN_SPIKE_ERRORS) & (F.col("timed_k0") / hours > F.col("usual") * factor)
            span = F.when(risen, _span(0, "rate_spike", "error", F.col("t0"), F.col("t1"), F.col("t0"), F.col("t1"), F.col("usual"))).otherwise(span)
        found.append(span)
    spans = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast(f"array<{_SPAN}>")
    return logs.select("log_path", F.explode(spans).alias("span"), F.lit(0).cast("long").alias("run"))


def _regions(counted: DataFrame, logs: DataFrame, window: int, multiplier: float) -> DataFrame:
    """(log_path, span, run) of runs of dense windows. Of the events at one time the first ones are dense, if any."""
    usual = logs.filter("timed >= 2").select("log_path", F.greatest(F.col("median") * multiplier, F.lit(float(C.MIN_BURST_EVENTS))).alias("limit"), F.when(F.col("base") > 0, F.col("base")).alias("base"))
    marked = counted.join(usual, "log_path")
    marked = marked.withColumn("dense", F.greatest(F.lit(0), F.least(F.col("n"), F.floor(F.col("f_n") - F.col("limit")).cast("long") + 1)))
    before = Window.partitionBy("log_path", "bucket").orderBy("us").rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.select("log_path", "bucket", "us", "dense", "base", (F.col("n") - F.col("dense")).alias("broken"))
    marked = marked.withColumn("_run", F.coalesce(F.sum("broken").over(before), F.lit(0)))
    # A run ends where an event isn't dense. One row for each run in a bucket, and one for what is between them, is all that
    # is gathered by log: the number of such events in earlier buckets makes a run's number the same in all of its buckets.
    small = marked.groupBy("log_path", "bucket", F.when(F.col("dense") > 0, F.col("_run")).alias("_run"))
    small = small.agg(F.sum("broken").alias("broken"), F.min("us").alias("low"), F.max("us").alias("high"), F.max("base").alias("base"))
    earlier = Window.partitionBy("log_path").orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    small = small.withColumn("_start", F.coalesce(F.sum("broken").over(earlier), F.lit(0))).filter("_run IS NOT NULL")
    runs = small.groupBy("log_path", (F.col("_run") + F.col("_start")).alias("run")).agg(F.min("low").alias("low"), (F.max("high") + window).alias("high"), F.max("base").alias("base"))
    return runs.select("log_path", _span(BURSTS, "error_burst", "", low=F.col("low"), high=F.col("high"), base=F.col("base").cast("double")).alias("span"), F.col("run").cast("long").alias("run"))


def _signals(marked: DataFrame, spans: DataFrame, wanted: set[int], window: int) -> DataFrame:
    """The events of each span, summed up."""
    seq = F.filter(F.array(*[F.when(F.col("us").isNotNull() if i == BURSTS else F.col(f"k{i}"), F.lit(i)) for i in sorted(wanted)]), lambda x: x.isNotNull())
    held = marked.select("log_path", "line_number", "message", "severity", "ts", "us", F.explode(seq).alias("seq"))
    if BURSTS in wanted:
        # A long region meets the events of its own buckets only.
        held = held.withColumn("cell", F.when(F.col("seq") == BURSTS, home("us", window)).otherwise(0))
        cells = F.when(F.col("span.seq") == BURSTS, F.sequence(home("span.low", window), home("span.high", window))).otherwise(F.array(F.lit(0).cast("long")))
    else:
        held, cells = held.withColumn("cell", F.lit(0).cast("long")), F.array(F.lit(0).cast("long"))
    ranges = spans.select(F.col("log_path").alias("_log"), "run", "span", F.explode(cells).alias("_cell")).select("_log", "run", "_cell", F.col("span.seq").alias("_seq"), "span.kind", F.col("span.severity").alias("given"), "span.low", "span.high", "span.first", "span.last", "span.base", "span.ordered")
    inside = F.col("low").isNull() | F.col("us").between(F.col("low"), F.col("high"))
    met = held.join(ranges, (F.col("log_path") == F.col("_log")) & (F.col("seq") == F.col("_seq")) & (F.col("cell") == F.col("_cell")) & inside)
    # A region lasts over all its events, but only warnings or worse count.
    met = met.withColumn("counts", (F.col("seq") != BURSTS) | is_significant(F.col("severity")))
    worst = F.min(F.when(F.col("counts"), F.struct(rank(F.col("severity")).alias("r"), F.col("severity").alias("s"))))["s"]
    sums = met.groupBy("log_path", "seq", "run", "kind", "given", "first", "last", "base").agg(F.min("us").alias("t0"), F.max("us").alias("t1"), F.count_if("counts").alias("event_count"), worst.alias("worst"))
    sums = sums.filter((F.col("seq") != BURSTS) | (F.col("event_count") >= C.MIN_BURST_EVENTS))
    in_order = Window.partitionBy("log_path", "seq", "run").orderBy(F.when(F.col("ordered"), F.col("us")), "line_number")
    heads = met.filter("counts").withColumn("at", F.row_number().over(in_order)).filter(F.col("at") <= C.SAMPLES)
    heads = heads.groupBy("log_path", "seq", "run").agg(F.array_sort(F.collect_list(F.struct("at", F.struct("line_number", "message", "severity", "ts").alias("event")))).alias("heads"))
    out = sums.join(heads, ["log_path", "seq", "run"])
    severity = F.when(F.col("seq") == BURSTS, F.col("worst")).otherwise(F.col("given"))
    return out.select("log_path", F.col("seq").alias("detector_seq"), "kind", F.coalesce("first", "t0").alias("start"), F.coalesce("last", "t1").alias("end"), "event_count", F.col("base").alias("baseline_count"), severity.alias("severity"), F.transform("heads", lambda x: x["event"]).alias("samples"))


def detect(events: DataFrame, window_minutes: float = 5, multiplier: float = 3.0, threshold: int = 10, factor: float = 3.0, baselines: DataFrame | None = None, wanted: Iterable[int] = ALL) -> DataFrame:
    """The signals of the ``wanted`` detectors, with their order in ``detector_seq``. ``baselines`` (log_path,
    avg_errors_per_hour): a log's errors by the hour above ``factor`` times the usual are a spike instead of a burst."""
    wanted, window = set(wanted), int(window_minutes * 60_000_000)
    flags = _flags(wanted)
    marked = events.select("log_path", "line_number", "message", "severity", "ts", micros().alias("us"), *[flag.alias(name) for name, flag in flags.items()])
    counts = {name: F.col(name) for name in flags} | ({"sig": is_significant(F.col("severity"))} if BURSTS in wanted else {})
    ticks = marked.groupBy("log_path", "us").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(name) for name, c in counts.items()])
    timed = F.col("us").isNotNull()
    logs = ticks.groupBy("log_path").agg(F.sum("n").alias("all_n"), F.sum(F.when(timed, F.col("n")).otherwise(0)).alias("timed"), F.min("us").alias("t0"), F.max("us").alias("t1"), *[F.sum(c).alias(f"all_{c}") for c in flags], *[F.sum(F.when(timed, F.col(c)).otherwise(0)).alias(f"timed_{c}") for c in flags])

    near = sorted(wanted & set(CLUSTERS))
    names = [f"k{i}" for i in near] + (["n", "sig"] if BURSTS in wanted else [])
    if names:
        counted = ahead(ticks, names, window)
        best = [F.max(F.when(F.col(f"k{i}") > 0, F.struct(F.col(f"f_k{i}").alias("n"), (-F.col("us")).alias("us")))).alias(f"best_k{i}") for i in near]
        if BURSTS in wanted:
            best += [F.median("n_forward").alias("median"), F.median("f_sig").alias("base")]
        logs = logs.join((each(counted) if BURSTS in wanted else counted).groupBy("log_path").agg(*best), "log_path", "left")
    if baselines is not None:
        logs = logs.join(baselines.select("log_path", F.col("avg_errors_per_hour").alias("usual")), "log_path", "left")
    spans = _fixed(logs, wanted, window, threshold, factor, baselines is not None)
    if BURSTS in wanted:
        spans = spans.unionByName(_regions(counted, logs, window, multiplier))
    return _signals(marked, spans, wanted, window).select(SIGNAL)
