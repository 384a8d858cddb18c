import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from timbrel.formats import engine, stateful

D = dt.datetime
#: Lines of a log, its path, and the events wanted: line, time, severity, source, message.
LOGS = {
    "zeek": ("conn.log", "#separator \\x09\n#path\tconn\n#fields\tts\tuid\tid.orig_h\tid.resp_h\tid.resp_p\tproto\tconn_state\n1592654701.5\tC1\t10.0.0.1\t10.0.0.2\t80\ttcp\tREJ\n#path\tnotice\n#fields\tts\tuid\tnote\tmsg\n1592654702\tC2\tScan\tport scan\n1592654703\tC3\tScan", [
        (4, D(2020, 6, 20, 12, 5, 1, 500000), "warning", "zeek-conn", "tcp 10.0.0.1 -> 10.0.0.2:80 [REJ]"),
        (7, D(2020, 6, 20, 12, 5, 2), "warning", "zeek-notice", "port scan"),
        (8, D(2020, 6, 20, 12, 5, 3), "warning", "zeek-notice", "Scan"),
    ]),
    "iis": ("u_ex.log", "#Software: IIS\n#Fields: date time s-ip cs-method cs-uri-stem sc-status time-taken\n2024-05-01 10:00:00 10.0.0.1 GET /a 200 5\n#Fields: date time cs-method cs-uri-stem sc-status\n2024-05-01 10:00:01 GET /b 503\nshort", [
        (3, D(2024, 5, 1, 10), "info", "iis", "GET /a -> 200"),
        (5, D(2024, 5, 1, 10, 0, 1), "error", "iis", "GET /b -> 503"),
    ]),
    "cloudfront": ("cf.log", "#Version: 1.0\n#Fields: date time x-edge-location c-ip cs-method cs-uri-stem sc-status\n2024-05-01\t10:00:00\tFRA2\t1.2.3.4\tGET\t/x y\t404", [
        (3, D(2024, 5, 1, 10), "warning", "cloudfront", "GET /x y -> 404"),
    ]),
    "oracle": ("db/alert_x.log", "2024-05-01T10:00:00.000+00:00\nStarting ORACLE instance (normal)\nORA-00600: internal error\n2024-05-01T10:05:00+00:00\nErrors in file /x.trc:\nORA-01555: snapshot too old", [
        (2, D(2024, 5, 1, 10), "info", "oracle", "Starting ORACLE instance (normal)"),
        (3, D(2024, 5, 1, 10), "critical", "oracle", "ORA-00600: internal error"),
        (5, D(2024, 5, 1, 10, 5), "warning", "oracle", "Errors in file /x.trc:"),
        (6, D(2024, 5, 1, 10, 5), "error", "oracle", "ORA-01555: snapshot too old"),
    ]),
    "mysql": ("slow.log", "# Time: 2024-05-01T10:00:00.5Z\n# User@Host: root[root] @ localhost []  Id: 12\n# Query_time: 6.5  Lock_time: 0.1 Rows_sent: 1  Rows_examined: 900\nSET timestamp=1;\nSELECT 1;\n2024-05-01T10:00:02.000000Z 0 [Warning] [MY-1] [Server] odd\nFROM t;\n# Query_time: 1.0  Lock_time: 0.1 Rows_sent: 1  Rows_examined: 7", [
        (3, D(2024, 5, 1, 10, 0, 0, 500000), "error", "mysql", "Slow query 6.500s by root[root]@localhost (rows_examined=900)"),
        (6, D(2024, 5, 1, 10, 0, 2), "warning", "mysql", "odd"),
        (8, None, "warning", "mysql", "Slow query 1.000s by ? (rows_examined=7)"),
    ]),
    "kubernetes": ("/var/log/pods/a_b_c/x/0.log", '2024-05-01T10:00:00.25Z stderr F bad thing\n{"log":"hello\\n","stream":"stdout","time":"2024-05-01T10:00:01Z"}', [
        (1, D(2024, 5, 1, 10, 0, 0, 250000), "warning", "kubernetes", "bad thing"),
        (2, D(2024, 5, 1, 10, 0, 1), "info", "kubernetes", "hello\n"),
    ]),
    "pingdirectory": ("errors", '[11/Apr/2011:10:31:53.783 -0500] category=SYNC severity=SEVERE_ERROR msgID=45 op=7 pipe="a_b" msg="went wrong"\n[01/Jun/2011:11:10:19.700 -0500] BIND RESULT conn=49 op=0 resultCode=49', [
        (1, D(2011, 4, 11, 10, 31, 53, 783000), "error", "pingdatasync", "went wrong"),
        (2, D(2011, 6, 1, 11, 10, 19, 700000), "warning", "pingdirectory", "BIND RESULT conn=49 op=0 resultCode=49"),
    ]),
    "pingfederate": ("pf.log", "2025-09-02 11:02:32,869 tid:Z8I INFO [a.b.C] Processing\n2024-11-28 05:58:55,832 | Administrator | UserAdmin | 81.2.69.142 | A | LICENSE | - Login failed", [
        (1, D(2025, 9, 2, 11, 2, 32, 869000), "info", "pingfederate", "Processing"),
        (2, D(2024, 11, 28, 5, 58, 55, 832000), "warning", "pingfederate", "Administrator | UserAdmin | 81.2.69.142 | A | LICENSE | - Login failed"),
    ]),
    "pingaccess": ("pa.log", "2025-09-02T11:02:32,869  INFO [ex-42] com.pingidentity.pa.Foo:88 - Started\n2025-09-02T11:02:33,000| ex| t| 12 ms| u| 10.0.0.5| GET| /api| 503", [
        (1, D(2025, 9, 2, 11, 2, 32, 869000), "info", "pingaccess", "Started"),
        (2, D(2025, 9, 2, 11, 2, 33), "error", "pingaccess", "ex| t| 12 ms| u| 10.0.0.5| GET| /api| 503"),
    ]),
    "pingintelligence": ("ase.log", "[Tue Aug 14 22:51:49:707 2018] [thread:209] [info] [type:connection_drop] GET /decoy\n[Tue Aug 14 22:52:03:114 2018] [thread:12] [error] failed", [
        (1, D(2018, 8, 14, 22, 51, 49, 707000), "warning", "pingintelligence", "[type:connection_drop] GET /decoy"),
        (2, D(2018, 8, 14, 22, 52, 3, 114000), "error", "pingintelligence", "failed"),
    ]),
    "ftp": ("f.log", 'Mon Dec  4 08:25:05 2023 [pid 1235] [anonymous] FAIL LOGIN: Client "1.2.3.4"\nMon Dec  4 08:25:13 2023 1 192.168.1.100 551 /a.tgz b _ o r user ftp 0 * c', [
        (1, D(2023, 12, 4, 8, 25, 5), "warning", "ftp", 'FAIL LOGIN: Client "1.2.3.4"'),
        (2, D(2023, 12, 4, 8, 25, 13), "info", "ftp", "1 192.168.1.100 551 /a.tgz b _ o r user ftp 0 * c"),
    ]),
    "wpa_supplicant": ("w.log", "Jun 28 10:15:01 host wpa_supplicant[1234]: wlan0: SME: Trying to authenticate\nwlan0: CTRL-EVENT-DISCONNECTED bssid=aa reason=3", [
        (1, D(2024, 6, 28, 10, 15, 1), "info", "wpa_supplicant", "SME: Trying to authenticate"),
        (2, None, "error", "wpa_supplicant", "CTRL-EVENT-DISCONNECTED bssid=aa reason=3"),
    ]),
    "klog": ("k.log", "E0623 10:15:01.123456       1 main.go:12] it failed", [(1, D(2024, 6, 23, 10, 15, 1, 123456), "error", "klog", "it failed")]),
    "snort": ("s.log", "06/23-10:15:01.5  [**] [1:2:3] SCAN [**] [Priority: 1] {TCP} 1.2.3.4:1 -> 5.6.7.8:2", [(1, D(2024, 6, 23, 10, 15, 1, 500000), "error", "snort", "SCAN")]),
    "redis": ("r.log", "12:M 14 Nov 2023 07:01:22.119 # Can't save in background: fork failed\n[7] 14 Nov 07:01:22.119 * ready", [
        (1, D(2023, 11, 14, 7, 1, 22, 119000), "error", "redis", "Can't save in background: fork failed"),
        (2, D(2024, 11, 14, 7, 1, 22, 119000), "info", "redis", "ready"),
    ]),
    "log4j": ("app.log", "2024-05-01 10:00:00,123 [main] ERROR a.b.C - went wrong\njava.lang.NullPointerException: x\n\tat a.b.C\njunk\nCaused by: y\n2024-05-01 10:00:01,000 [main] INFO a.b.C - fine", [
        (1, D(2024, 5, 1, 10, 0, 0, 123000), "error", "a.b.C", "went wrong\njava.lang.NullPointerException: x\n\tat a.b.C\nCaused by: y"),
        (6, D(2024, 5, 1, 10, 0, 1), "info", "a.b.C", "fine"),
    ]),
}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(path, n, raw) for path, text, _ in LOGS.values() for n, raw in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, "log_path string, line_number long, raw string").cache()


def test_logs_find_their_formats(lines):
    found = {r["log_path"]: r["format"] for r in engine.detect(lines).collect()}
    assert found == {path: name for name, (path, _, _) in LOGS.items()}
    kept = {r["log_path"]: r["format"] for r in engine.covered(lines, engine.detect(lines)).collect()}
    assert kept == found


def test_events(lines, spark):
    formats = spark.createDataFrame([(path, name) for name, (path, _, _) in LOGS.items()], "log_path string, format string")
    got = {}
    for r in engine.parse_all(lines, formats, 2024).orderBy("log_path", "line_number").collect():
        got.setdefault(r["log_path"], []).append((r["line_number"], r["ts"], r["severity"], r["source"], r["message"]))
    assert got == {path: events for path, _, events in LOGS.values()}


def test_structure_is_counted(lines, spark):
    formats = spark.createDataFrame([(path, name) for name, (path, _, _) in LOGS.items()], "log_path string, format string")
    meta = {r["log_path"]: r["n"] for r in engine.read_all(lines, formats, 2024).filter("meta").groupBy("log_path").agg(F.count("*").alias("n")).collect()}
    assert meta == {"conn.log": 5, "u_ex.log": 3, "cf.log": 2, "db/alert_x.log": 2, "slow.log": 5, "app.log": 3}


def test_values_are_carried_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKET", 7)
    rng = random.Random(1)
    rows = [(log, n, rng.choice([None, None, None, f"{log}{n}"])) for log in "ab" for n in range(1, 100)]
    frame = spark.createDataFrame(rows, "log_path string, line_number long, v string")
    want, now = [], {}
    for log, n, v in rows:
        before = now.get(log)
        now[log] = v or before
        want.append((log, n, now[log], before))
    out = stateful.carried(stateful.carried(frame, {"here": F.col("v"), "twice": F.concat("v", "v")}), {"before": F.col("v")}, behind=True)
    assert sorted((r["log_path"], r["line_number"], r["here"], r["before"]) for r in out.collect()) == sorted(want)
