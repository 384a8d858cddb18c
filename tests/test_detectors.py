import datetime as dt
import random

import pytest

from timbrel.operators import correlation, detectors, windows
from timbrel.operators.lines import duration, fold
from timbrel.plans import inference, state, summary

BASE = dt.datetime(2024, 5, 1)
SCHEMA = "log_path string, line_number long, ts timestamp_ntz, severity string, source string, message string, action string, is_squid boolean, result_code string, http_status int, method string, connect_port int"


def event(minute, severity="info", message="m", line=1, log="a", source="app", action=None, squid=False, code=None, status=None, method=None, port=None):
    ts = None if minute is None else BASE + dt.timedelta(minutes=minute)
    return (log, line, ts, severity, source, message, action, squid, code, status, method, port)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_forward_counts_match_a_loop_with_ties(spark):
    rng = random.Random(3)
    rows = [event(rng.randrange(60), rng.choice(["info", "warning", "error"]), line=i) for i in range(300)]
    window = dt.timedelta(minutes=5)
    order = sorted(rows, key=lambda r: (r[2], r[1]))
    want = {}
    for i, r in enumerate(order):
        want[r[1]] = (sum(x[2] <= r[2] + window for x in order[i:]), sum(r[2] <= x[2] <= r[2] + window and x[3] != "info" for x in order))
    got = windows.forward_counts(windows.with_us(frame(spark, rows)), 300_000_000).collect()
    assert {r["line_number"]: (r["n_forward"], r["n_significant"]) for r in got} == want


def signals(spark, rows, **more):
    return sorted(detectors.detect(frame(spark, rows), **more).collect(), key=lambda r: (r["detector_seq"], r["start"] or 0))


def test_even_spacing_and_quiet_spikes_give_nothing(spark):
    assert signals(spark, [event(i * 10, "error", line=i) for i in range(40)]) == []
    assert signals(spark, [event(i * 10, line=i) for i in range(40)] + [event(200 + i / 100, line=100 + i) for i in range(40)]) == []


def test_a_burst_is_one_region_and_two_are_two(spark):
    rows = [event(i * 10, line=i) for i in range(60)] + [event(200 + i / 60, "error", line=100 + i) for i in range(30)]
    found = signals(spark, rows)
    assert [(r["kind"], r["event_count"], r["severity"]) for r in found] == [("error_burst", 30, "error")] * 2
    assert all(len(r["samples"]) == 20 for r in found)
    rows += [event(400 + i / 60, "warning", line=200 + i) for i in range(30)]
    assert [r["detector_seq"] for r in signals(spark, rows)] == [0, 1, 1]


def test_untimed_logs(spark):
    rows = [event(None, "error", "failed password", line=i) for i in range(12)] + [event(None, line=50 + i) for i in range(20)]
    assert [(r["kind"], r["event_count"], r["start"]) for r in signals(spark, rows)] == [("error_burst", 12, None), ("auth_failure_cluster", 12, None)]
    assert signals(spark, []) == []


def test_words_firewall_and_proxy(spark):
    rows = [event(1, message="Out of memory: Killed process 3", line=1), event(2, "warning", "Failed to start x", line=2), event(3, message="failed to start y", line=3), event(4, message="No space left on device", line=4)]
    rows += [event(10 + i / 60, source="ufw", action="BLOCK", line=20 + i) for i in range(12)]
    rows += [event(20 + i / 60, squid=True, code="TCP_DENIED/403", status=403, line=40 + i) for i in range(10)] + [event(30, squid=True, method="CONNECT", port=2222, line=80)]
    found = {(r["detector_seq"], r["kind"]): r["event_count"] for r in signals(spark, rows) if r["detector_seq"] > 1}
    assert found == {(3, "oom_event"): 1, (4, "service_crash"): 2, (5, "disk_full"): 1, (6, "firewall_block_cluster"): 12, (7, "proxy_denial_cluster"): 10, (8, "tunnel_anomaly"): 1}


def test_rate_spike_replaces_the_burst(spark):
    rows = [event(i, "error", line=i) for i in range(30)]
    usual = spark.createDataFrame([("a", 1.0)], "log_path string, avg_errors_per_hour double")
    found = detectors.detect(frame(spark, rows), 60, baselines=usual, wanted=[0]).collect()
    assert [(r["kind"], r["baseline_count"]) for r in found] == [("rate_spike", 1.0)]


def test_merge_correlate_and_summarise(spark):
    rows = [event(i / 60, "error", "auth failure: failed password", line=i) for i in range(30)] + [event(100, message="oom-kill", line=99)]
    raw = detectors.detect(frame(spark, rows))
    final = correlation.correlate(correlation.merge(raw), 120_000_000)
    got = {r["position"]: r["kind"] for r in final.collect()}
    assert got[1] == "oom_event" and set(got.values()) == {"oom_event", "error_burst", "auth_failure_cluster"}
    logs = spark.createDataFrame([("a",), ("clean",)], "log_path string")
    out = {r["log_path"]: r for r in summary.summarize(logs, final, inference.lexical).collect()}
    assert (out["a"]["level"], out["a"]["category"], out["a"]["title"]) == ("CRITICAL", "oom", "Out of Memory")
    assert (out["clean"]["level"], out["clean"]["title"], out["clean"]["confidence"], out["clean"]["findings"]) == ("CLEAN", "No incidents detected", 1.0, [])
    assert summary.exit_code("CRITICAL") == 4


def test_a_chain_of_near_starts_is_one_group(spark):
    rows = [("a", i, k, s * 10**6, e * 10**6, 10, None, "warning", []) for i, (k, s, e) in enumerate([("x", 0, 600), ("y", 30, 40), ("z", 650, 660), ("w", 900, 910)])]
    schema = "log_path string, detector_seq int, kind string, start bigint, end bigint, event_count bigint, baseline_count double, severity string, samples array<struct<line_number:bigint,message:string,severity:string,ts:timestamp_ntz>>"
    got = correlation.correlate(spark.createDataFrame(rows, schema), 120_000_000).collect()
    assert {r["kind"]: (r["group_id"], r["group_size"]) for r in got} == {"x": (1, 3), "y": (1, 3), "z": (1, 3), "w": (2, 1)}


def test_baselines_move(spark):
    new = state.metrics(frame(spark, [event(i, "error", line=i) for i in range(61)]))
    first = state.upsert(spark.createDataFrame([], "log_path string, avg_events_per_hour double, avg_errors_per_hour double, p95_burst_size double, sample_count int"), new)
    assert first.first()["sample_count"] == 1 and first.first()["avg_events_per_hour"] == pytest.approx(61)
    again = state.upsert(first, new.withColumn("avg_events_per_hour", new["avg_events_per_hour"] * 2)).first()
    assert again["sample_count"] == 2 and again["avg_events_per_hour"] == pytest.approx(0.8 * 61 + 0.2 * 122)


def test_leaders_follow_order(spark):
    rows = [("a", 0, [1.0, 0.0]), ("a", 1, [0.9, 0.1]), ("a", 2, [0.0, 1.0])]
    got = inference.leaders(spark.createDataFrame(rows, "log_path string, n long, vector array<double>")).collect()
    assert {r["n"]: r["leader"] for r in got} == {0: 0, 1: 0, 2: 2}


def test_folding_keeps_twenty_lines(spark):
    from pyspark.sql import functions as F

    rows = [("a", 1, "E first"), ("a", 2, "  at x"), ("a", 3, "junk"), ("a", 4, "  at y"), ("a", 5, "E second")] + [("a", 6 + i, f"  at {i}") for i in range(30)]
    out = fold(spark.createDataFrame(rows, "log_path string, line_number long, raw string"), F.col("raw").startswith("E"), F.col("raw").startswith("  at")).orderBy("line_number").collect()
    assert [(r["raw"].count("\n"), r["folded"]) for r in out] == [(2, 2), (20, 30)] and "junk" not in out[0]["raw"]


def test_durations():
    assert duration("90m") == dt.timedelta(minutes=90)
    with pytest.raises(ValueError):
        duration("soon")
