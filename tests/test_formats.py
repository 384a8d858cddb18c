import bz2
import datetime as dt
import gzip

import pytest

from timbrel.formats import engine
from timbrel.sources import text

LOGS = {
    "nginx-access": '10.0.0.1 - - [01/May/2024:10:00:00 +0200] "GET /x HTTP/1.1" 502 12 "-" "curl"',
    "squid": "1714550400.123 10 10.0.0.2 TCP_DENIED/403 0 CONNECT host.test:2222 - HIER_NONE/- -",
    "secure": "May  1 10:00:00 web sshd[12]: Failed password for root from 10.0.0.9 port 22",
    "log4j": "2024-05-01 10:00:00,123 [main] ERROR a.b.C - went wrong",
    "logfmt": 'ts=2024-05-01T10:00:00Z level=warn msg="slow call" took=3s',
    "pino": '{"level":50,"time":1714557600000,"pid":3,"msg":"bad thing"}',
    "ufw": "May  1 10:00:00 fw kernel: [1.0] [UFW BLOCK] IN=eth0 SRC=1.2.3.4",
    "syslog": "May  1 10:00:00 web myapp[3]: 0 errors found",
    "generic": "2024-05-01 10:00:00 something ERROR happened",
}
WANT = {
    "nginx-access": ("error", dt.datetime(2024, 5, 1, 10)),
    "squid": ("warning", dt.datetime(2024, 5, 1, 8, 0, 0, 123000)),
    "secure": ("warning", dt.datetime(2024, 5, 1, 10)),
    "log4j": ("error", dt.datetime(2024, 5, 1, 10, 0, 0, 123000)),
    "logfmt": ("warning", dt.datetime(2024, 5, 1, 10)),
    "pino": ("error", dt.datetime(2024, 5, 1, 10)),
    "ufw": ("warning", dt.datetime(2024, 5, 1, 10)),
    "syslog": ("info", dt.datetime(2024, 5, 1, 10)),
    "generic": ("error", dt.datetime(2024, 5, 1, 10)),
}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(name, n, line) for name, line in LOGS.items() for n in (1, 3)] + [(name, 2, "") for name in LOGS]
    return spark.createDataFrame(rows, "log_path string, line_number long, raw string").cache()


def test_each_log_finds_its_format(lines):
    assert {r["log_path"]: r["format"] for r in engine.detect(lines).collect()} == {n: n for n in LOGS}


def test_events(lines):
    events = engine.parse_all(lines, engine.detect(lines)).filter("line_number = 1").collect()
    assert {r["log_path"]: (r["severity"], r["ts"]) for r in events} == WANT
    squid = next(r for r in events if r["log_path"] == "squid")
    assert (squid["is_squid"], squid["connect_port"], squid["http_status"], squid["result_code"]) == (True, 2222, 403, "TCP_DENIED")


def test_low_coverage_falls_back(spark):
    rows = [("x", 1, LOGS["log4j"])] + [("x", i, f"plain line {i}") for i in range(2, 9)]
    frame = spark.createDataFrame(rows, "log_path string, line_number long, raw string")
    formats = spark.createDataFrame([("x", "log4j")], "log_path string, format string")
    assert engine.covered(frame, formats).first()["format"] == "generic"


def test_names_and_aliases():
    assert engine.named("K8S").name == "kubernetes"
    with pytest.raises(ValueError, match="nginx"):
        engine.named("nginx-acess")


def test_archives_and_encodings(spark, tmp_path):
    plain = "one\n\nthrée\n".encode()
    (tmp_path / "a.log").write_bytes(plain)
    (tmp_path / "b.log").write_bytes(gzip.compress(plain))
    (tmp_path / "c.log").write_bytes(bz2.compress(plain))
    (tmp_path / "d.log").write_bytes(plain.decode().encode("utf-16"))
    many = "\n".join(str(i * 7919 % 10007) for i in range(20_000)).encode()
    (tmp_path / "e.log").write_bytes(gzip.compress(many)[:-200])
    got = text.read_logs(spark, str(tmp_path)).collect()
    by = {}
    for r in got:
        by.setdefault(r["log_path"][-5], []).append((r["line_number"], r["raw"], r["cut"]))
    for k in "abcd":
        assert sorted(by[k]) == [(1, "one", False), (2, "", False), (3, "thrée", False)]
    assert all(c for _, _, c in by["e"])


def test_path_guard(tmp_path):
    with pytest.raises(text.PathError):
        text.check_path(str(tmp_path))
    (tmp_path / "x.log").write_text("a")
    with pytest.raises(text.PathError):
        text.check_path(str(tmp_path / "x.log"), allowed=["/nowhere"])
    assert text.check_path(str(tmp_path / "x.log")).endswith("x.log")


def test_lines_end_at_line_ends_only(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("a\x0cb c\r\nd\x85\n\ne".encode())
    assert [(r["line_number"], r["raw"]) for r in text.read_logs(spark, str(tmp_path / "a.log")).orderBy("line_number").collect()] == [(1, "a\x0cb c"), (2, "d\x85"), (3, ""), (4, "e")]
    for n in range(3):
        (tmp_path / f"p{n}.txt").write_text("".join(f"{n} {i}\n" for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = text.read_plain(spark, *[str(tmp_path / f"p{n}.txt") for n in range(3)]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["log_path"][-5], r["line_number"], r["raw"]) for r in rows) == sorted((str(n), i + 1, f"{n} {i}") for n in range(3) for i in range(500))


def test_mixed_formats_round_times_as_their_sql_does(spark, tmp_path):
    import duckdb

    from timbrel import queries

    # Rounded to the millisecond, the first two lie in one second and the third in the next minute's first.
    micros = [1_000_000, 999_500, 59_999_600, 60_000_000, 2_000_499, 2_000_501, 2_000_900, 3_999_499, 86_399_999_900]
    stamps = [dt.datetime(2024, 1, 31) + dt.timedelta(microseconds=us) for us in micros]
    rows = [(i, ts, i, ("click", "error", "signup")[i % 9 // 4]) for i, ts in enumerate(stamps)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, queries.QUERIES["mixed_formats_parse"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
        assert got == sorted(db.sql(queries.ORACLE_SQL["mixed_formats_parse"]).fetchall())
