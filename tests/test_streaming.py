import pytest
from pyspark.sql import functions as F

from timbrel.formats import engine
from timbrel.streaming import follow


def access(minute, second, status):
    return f'10.0.0.1 - - [01/May/2024:10:{minute:02d}:{second:02d} +0000] "GET /x HTTP/1.1" {status} 12 "-" "curl"\n'


def test_alerts_of_a_growing_folder(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    stream = follow.error_windows(follow.events(follow.lines(spark, str(logs)), "nginx-access"), keys=())
    first = [(m, s, 500 if m == 3 else 200) for m in range(10) for s in range(0, 60, 3)]
    (logs / "a.log").write_text("".join(access(*x) for x in first) + "no event\n")
    follow.write(stream, out, str(tmp_path / "state"), once=True).awaitTermination()
    second = [(m, s, 200) for m in range(30, 50) for s in range(0, 60, 3)] + [(55, 0, 200)]
    for name, rows in (("b", second), ("c", [(4, 1, 500)]), ("d", [(56, 0, 200)])):  # a run closes what its predecessor's watermark left behind
        (logs / f"{name}.log").write_text("".join(access(*x) for x in rows))
        follow.write(stream, out, str(tmp_path / "state"), once=True).awaitTermination()
    got = {(r["start"].minute, r["errors"]) for r in spark.read.parquet(out).collect()}
    frame = spark.createDataFrame([("l", 1, access(*x).strip()) for x in first], "log_path string, line_number long, raw string")
    batch = follow.error_windows(engine.parse(frame, "nginx-access"), keys=())
    want = {(r["start"].minute, r["errors"]) for r in batch.collect()}
    # An error that came 50 minutes late is in no window.
    assert got == want and max(n for _, n in want) == 20


def test_spikes_and_refused_formats(spark):
    rows = [("a", 10, 20), ("b", 10, 20)]
    alerts = spark.createDataFrame(rows, "log_path string, errors long, n long").select("log_path", F.timestamp_seconds(F.lit(0)).alias("start"), F.timestamp_seconds(F.lit(300)).alias("end"), "errors")
    usual = spark.createDataFrame([("a", 1.0), ("b", 100.0)], "log_path string, avg_errors_per_hour double")
    assert [r["log_path"] for r in follow.spikes(alerts, usual).collect()] == ["a"]
    for name in ("mysql", "log4j"):
        with pytest.raises(ValueError):
            follow.events(None, name)
