"""Queries over the driver's tables, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel import constants as C
from timbrel.formats import engine
from timbrel.functions import severity as S
from timbrel.operators import correlation, detectors, windows
from timbrel.operators.lines import fold, last
from timbrel.plans import inference, state, summary
from timbrel.sources import adapters

WINDOW_MINUTES = 720
WINDOW = WINDOW_MINUTES * 60_000_000
MULTIPLIER = 1.3
THRESHOLD = 5
GAP = 6 * 3_600_000_000

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_BASE = f"WITH e AS (SELECT *, epoch_us(ts) AS us FROM (SELECT {adapters.EVENTS} FROM events)),\n"


def query(sql: str | None = None, base: bool = True):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (_BASE if base else "") + sql
        return f

    return register


def _like(column: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


_FORWARD = f"""f AS (SELECT *, count(*) OVER (PARTITION BY log_path ORDER BY us RANGE BETWEEN CURRENT ROW AND {WINDOW} FOLLOWING)
    - row_number() OVER (PARTITION BY log_path, us ORDER BY line_number) + 1 AS n_forward,
    count(*) FILTER (severity IN ('warning', 'error', 'critical')) OVER (PARTITION BY log_path ORDER BY us RANGE BETWEEN CURRENT ROW AND {WINDOW} FOLLOWING) AS n_significant
  FROM e WHERE ts IS NOT NULL)"""


def _cluster_sql(where: str, kind: str, severity: str, name: str, least: int = THRESHOLD) -> str:
    """The densest window of chosen events."""
    return f"""{name}_f AS (SELECT *, count(*) OVER (PARTITION BY log_path ORDER BY us RANGE BETWEEN CURRENT ROW AND {WINDOW} FOLLOWING)
    - row_number() OVER (PARTITION BY log_path, us ORDER BY line_number) + 1 AS n FROM e WHERE {where}),
{name}_b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_path ORDER BY n DESC, us, line_number) AS r FROM {name}_f) WHERE r = 1 AND n >= {least}),
{name} AS (SELECT b.log_path, '{kind}' AS kind, min(m.us) AS start, max(m.us) AS "end", count(*) AS event_count, CAST(NULL AS DOUBLE) AS baseline_count, '{severity}' AS severity
  FROM {name}_b b JOIN {name}_f m ON m.log_path = b.log_path AND m.us <= b.us + {WINDOW} AND (m.us > b.us OR (m.us = b.us AND m.line_number >= b.line_number)) GROUP BY ALL)"""


def _occurrence_sql(where: str, kind: str, severity: str, name: str) -> str:
    return f"""{name} AS (SELECT log_path, '{kind}' AS kind, min(us) AS start, max(us) AS "end", count(*) AS event_count, CAST(NULL AS DOUBLE) AS baseline_count, '{severity}' AS severity
  FROM e WHERE {where} GROUP BY log_path)"""


_ERRORS_SQL = _cluster_sql("severity IN ('error', 'critical')", "error_burst", "error", "s0", C.MIN_BURST_EVENTS)
_BURST_SQL = f"""{_FORWARD},
base AS (SELECT log_path, median(n_forward) AS med, median(n_significant) AS sig, count(*) AS n FROM f GROUP BY log_path),
marked AS (SELECT f.*, base.sig, n_forward >= greatest(med * {MULTIPLIER}, {C.MIN_BURST_EVENTS}) AS dense FROM f JOIN base USING (log_path) WHERE n >= 2),
runs AS (SELECT *, sum(CASE WHEN dense THEN 0 ELSE 1 END) OVER (PARTITION BY log_path ORDER BY us, line_number) AS run FROM marked),
spans AS (SELECT log_path, run, arg_min(us, (us, line_number)) AS us0, arg_min(line_number, (us, line_number)) AS line0, max(us) + {WINDOW} AS us1, max(sig) AS sig FROM runs WHERE dense GROUP BY log_path, run),
held AS (SELECT s.run, s.sig, e.* FROM spans s JOIN e ON e.log_path = s.log_path AND e.us <= s.us1 AND (e.us > s.us0 OR (e.us = s.us0 AND e.line_number >= s.line0))),
s1 AS (SELECT log_path, 'error_burst' AS kind, min(us) AS start, max(us) AS "end", count(*) FILTER (severity IN ('warning', 'error', 'critical')) AS event_count,
  CASE WHEN max(sig) > 0 THEN CAST(max(sig) AS DOUBLE) END AS baseline_count,
  CASE min(CASE severity WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 9 END) WHEN 0 THEN 'critical' WHEN 1 THEN 'error' ELSE 'warning' END AS severity
  FROM held GROUP BY log_path, run HAVING count(*) FILTER (severity IN ('warning', 'error', 'critical')) >= {C.MIN_BURST_EVENTS})"""
_AUTH_SQL = _cluster_sql(_like("message", C.AUTH_PHRASES), "auth_failure_cluster", "warning", "s2")
_OOM_SQL = _occurrence_sql(_like("message", C.OOM_PHRASES), "oom_event", "critical", "s3")
_CRASH_SQL = _occurrence_sql(f"{_like('message', C.CRASH_PHRASES)} OR ({_like('message', C.WEAK_CRASH_PHRASES)} AND severity IN ('warning', 'error', 'critical'))", "service_crash", "error", "s4")
_DISK_SQL = _occurrence_sql(_like("message", C.DISK_PHRASES), "disk_full", "critical", "s5")
_FIRE_SQL = _cluster_sql("source IN ('ufw', 'filterlog', 'firewalld') AND lower(action) IN ('block', 'reject', 'drop')", "firewall_block_cluster", "warning", "s6")
_PROXY_SQL = ",\n".join([
    _cluster_sql("is_squid AND (contains(result_code, 'DENIED') OR http_status = 403)", "proxy_denial_cluster", "warning", "s7"),
    _occurrence_sql("is_squid AND method = 'CONNECT' AND connect_port NOT IN (80, 443, 8080, 8443)", "tunnel_anomaly", "warning", "s8"),
    _cluster_sql("is_squid AND http_status = 407", "auth_failure_cluster", "warning", "s9"),
    f"""s10 AS (SELECT log_path, 'error_burst' AS kind, min(us) AS start, max(us) AS "end", count(*) AS event_count, CAST(NULL AS DOUBLE) AS baseline_count, 'warning' AS severity
  FROM e WHERE is_squid AND result_code = 'TCP_MISS/200' AND log_path IN (SELECT log_path FROM e WHERE is_squid GROUP BY log_path HAVING count(*) >= {C.BYPASS_EVENTS} AND count(*) FILTER (result_code LIKE 'TCP_MISS/%') >= {C.BYPASS_SHARE} * count(*)) GROUP BY log_path)""",
])
_COLUMNS = 'log_path, kind, start, "end", event_count, baseline_count, severity'
_SHOWN = ["log_path", "kind", "start", "end", "event_count", "baseline_count", "severity"]


def _found(events: DataFrame, *wanted: int, baselines: DataFrame | None = None) -> DataFrame:
    return detectors.detect(events, WINDOW_MINUTES, MULTIPLIER, THRESHOLD, baselines=baselines, wanted=wanted)


def _pick(name: str) -> str:
    return f"SELECT {_COLUMNS} FROM {name}"


@query("h AS (SELECT severity, count(*) AS n, CAST(min(us) AS BIGINT) AS first_us FROM e GROUP BY severity) SELECT * FROM h")
def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = windows.with_us(adapters.events(spark, sf_dir))
    return e.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"))


@query(_FORWARD + " SELECT log_path, line_number, n_forward, n_significant FROM f")
def forward_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = windows.with_us(adapters.events(spark, sf_dir))
    return windows.forward_counts(e, WINDOW).select("log_path", "line_number", F.col("n_forward").cast("long").alias("n_forward"), "n_significant")


_DATED = "SELECT o_orderpriority AS log_path, o_orderkey AS line_number, epoch_us(o_orderdate) AS us FROM orders"


@query(f"""WITH d AS ({_DATED}) SELECT log_path, line_number, count(*) OVER (PARTITION BY log_path ORDER BY us RANGE BETWEEN CURRENT ROW AND 604800000000 FOLLOWING)
 - row_number() OVER (PARTITION BY log_path, us ORDER BY line_number) + 1 AS n_forward FROM d""", base=False)
def forward_counts_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    e = o.select(F.col("o_orderpriority").alias("log_path"), F.col("o_orderkey").alias("line_number"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.lit("info").alias("severity"))
    return windows.forward_counts(windows.with_us(e), 604_800_000_000).select("log_path", "line_number", F.col("n_forward").cast("long").alias("n_forward"))


@query(_ERRORS_SQL + " " + _pick("s0"))
def densest_error_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(adapters.events(spark, sf_dir), 0).select(_SHOWN)


@query(_BURST_SQL + " " + _pick("s1"))
def burst_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(adapters.events(spark, sf_dir), detectors.BURSTS).select(_SHOWN)


@query(f"""b AS (SELECT log_path, min(us) AS t0, max(us) AS t1, count(*) FILTER (severity IN ('error', 'critical')) AS n FROM e GROUP BY log_path)
SELECT log_path, 'rate_spike' AS kind, t0 AS start, t1 AS "end", n AS event_count, CASE log_path WHEN 'log-1' THEN 0.05 ELSE 0.2 END AS baseline_count, 'error' AS severity
FROM b WHERE n >= {C.MIN_SPIKE_ERRORS} AND n / greatest((t1 - t0) / 3.6e9, 1.0 / 3600) > 3 * CASE log_path WHEN 'log-1' THEN 0.05 ELSE 0.2 END""")
def rate_spike_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.events(spark, sf_dir)
    known = e.select("log_path").distinct().withColumn("avg_errors_per_hour", F.when(F.col("log_path") == "log-1", 0.05).otherwise(0.2))
    return _found(e, 0, baselines=known).filter("kind = 'rate_spike'").select(_SHOWN)


@query(f"""c AS (SELECT log_path, count(*) AS n, count(*) FILTER (severity IN ('error', 'critical')) AS bad FROM e GROUP BY log_path)
SELECT log_path, 'error_burst' AS kind, bad AS event_count, 'error' AS severity FROM c WHERE bad >= {C.MIN_BURST_EVENTS} AND bad >= {C.UNTIMED_SHARE} * n""")
def untimed_error_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.events(spark, sf_dir).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    return _found(e, 0).select("log_path", "kind", "event_count", "severity")


@query(",\n".join([_AUTH_SQL]) + " " + _pick("s2"))
def auth_failure_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(adapters.events(spark, sf_dir), 2).select(_SHOWN)


@query(",\n".join([_OOM_SQL, _CRASH_SQL, _DISK_SQL]) + f" {_pick('s3')} UNION ALL {_pick('s4')} UNION ALL {_pick('s5')}")
def keyword_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(adapters.events(spark, sf_dir), 3, 4, 5).select(_SHOWN)


@query(_FIRE_SQL + " " + _pick("s6"))
def firewall_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(adapters.events(spark, sf_dir), 6).select(_SHOWN)


@query(_PROXY_SQL + " " + " UNION ALL ".join(_pick(f"s{i}") for i in (7, 8, 9, 10)))
def proxy_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(adapters.events(spark, sf_dir), 7, 8, 9, 10).select(_SHOWN)


_ALL_SQL = ",\n".join([_ERRORS_SQL, _BURST_SQL, _AUTH_SQL, _OOM_SQL, _CRASH_SQL, _DISK_SQL, _FIRE_SQL, _PROXY_SQL])
_UNION_SQL = " UNION ALL ".join(f"SELECT {i} AS detector_seq, {_COLUMNS} FROM s{i}" for i in range(11))


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(adapters.events(spark, sf_dir), *detectors.ALL)


@query(_ALL_SQL + " " + _UNION_SQL)
def all_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).select("detector_seq", *_SHOWN)


_RANK_SQL = "CASE severity WHEN 'critical' THEN 0 WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END"
_GROUPS_SQL = f"""u AS ({_UNION_SQL}),
g0 AS (SELECT *, max("end") OVER (PARTITION BY log_path ORDER BY start, detector_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
g1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY log_path ORDER BY start, detector_seq ROWS UNBOUNDED PRECEDING) AS group_id FROM g0),
g2 AS (SELECT *, count(*) OVER (PARTITION BY log_path, group_id) AS group_size FROM g1),
g3 AS (SELECT *, row_number() OVER (PARTITION BY log_path ORDER BY {_RANK_SQL}, CASE WHEN group_size = 1 THEN 1 ELSE 0 END, start, detector_seq) AS position FROM g2)"""


@query(f"{_ALL_SQL}, {_GROUPS_SQL} SELECT log_path, detector_seq, kind, start, CAST(group_id AS BIGINT) AS group_id, group_size, position FROM g3")
def signal_gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlation.correlate(_all(spark, sf_dir), GAP).select("log_path", "detector_seq", "kind", "start", "group_id", "group_size", "position")


@query(f"""{_ALL_SQL}, {_GROUPS_SQL},
a AS (SELECT log_path, count(*) AS signal_count, bool_or(severity = 'critical') AS critical FROM g3 GROUP BY log_path),
c AS (SELECT log_path, arg_min(CASE kind WHEN 'oom_event' THEN 'oom' WHEN 'service_crash' THEN 'service_crash' WHEN 'disk_full' THEN 'disk_full' WHEN 'auth_failure_cluster' THEN 'auth_brute_force' ELSE 'network_issue' END, position) AS category
  FROM g3 WHERE kind NOT IN ('error_burst', 'rate_spike') GROUP BY log_path)
SELECT log_path, CASE WHEN critical THEN 'CRITICAL' ELSE 'WARNING' END AS level, coalesce(category, 'unknown') AS category, CASE WHEN category IS NULL THEN 0.5 ELSE 0.9 END AS confidence, signal_count,
 CASE category WHEN 'oom' THEN 'Out of Memory' WHEN 'service_crash' THEN 'Service Crash' WHEN 'disk_full' THEN 'Disk Full' WHEN 'auth_brute_force' THEN 'Auth Brute Force' WHEN 'network_issue' THEN 'Network Issue' ELSE 'Error burst detected' END AS title
FROM a LEFT JOIN c USING (log_path)""")
def incident_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = adapters.events(spark, sf_dir).select("log_path").distinct()
    found = summary.summarize(logs, correlation.correlate(_all(spark, sf_dir), GAP))
    return found.filter("signal_count > 0").select("log_path", "level", "category", F.col("confidence").cast("double").alias("confidence"), "signal_count", "title")


@query()
def incident_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detect, merge, correlate, classify by words, summarise. The merge depends on order, so SQL has no equal."""
    e = adapters.events(spark, sf_dir)
    signals = correlation.correlate(correlation.merge(_all(spark, sf_dir)), GAP)
    logs = e.groupBy("log_path").agg(F.count(F.lit(1)).alias("parsed_count"))
    return summary.summarize(logs, signals, inference.lexical)


_METRICS_SQL = f"""{_FORWARD}, m AS (SELECT log_path, count(*) / greatest((max(us) - min(us)) / 3.6e9, 1.0 / 3600) AS ev, count(*) FILTER (severity IN ('error', 'critical')) / greatest((max(us) - min(us)) / 3.6e9, 1.0 / 3600) AS er, quantile_cont(n_forward, 0.95) AS p95 FROM f GROUP BY log_path)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("log_path", *[F.round(c, 6).alias(c) for c in ("avg_events_per_hour", "avg_errors_per_hour", "p95_burst_size")], *[c for c in df.columns if c == "sample_count"])


@query(_METRICS_SQL + " SELECT log_path, round(ev, 6) AS avg_events_per_hour, round(er, 6) AS avg_errors_per_hour, round(p95, 6) AS p95_burst_size FROM m")
def baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(state.metrics(adapters.events(spark, sf_dir), WINDOW_MINUTES))


@query(_METRICS_SQL + """, o AS (SELECT log_path, ev * 2 AS ev0, er * 2 AS er0, p95 * 2 AS p0 FROM m WHERE log_path < 'log-4' UNION ALL SELECT 'gone.log', 1.0, 2.0, 3.0)
SELECT coalesce(m.log_path, o.log_path) AS log_path,
 round(CASE WHEN o.log_path IS NULL THEN ev WHEN m.log_path IS NULL THEN ev0 ELSE 0.2 * ev + 0.8 * ev0 END, 6) AS avg_events_per_hour,
 round(CASE WHEN o.log_path IS NULL THEN er WHEN m.log_path IS NULL THEN er0 ELSE 0.2 * er + 0.8 * er0 END, 6) AS avg_errors_per_hour,
 round(CASE WHEN o.log_path IS NULL THEN p95 WHEN m.log_path IS NULL THEN p0 ELSE 0.2 * p95 + 0.8 * p0 END, 6) AS p95_burst_size,
 CAST(CASE WHEN o.log_path IS NULL THEN 1 WHEN m.log_path IS NULL THEN 7 ELSE 8 END AS BIGINT) AS sample_count
FROM m FULL JOIN o ON m.log_path = o.log_path""")
def baseline_ema_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = state.metrics(adapters.events(spark, sf_dir), WINDOW_MINUTES)
    twice = new.filter("log_path < 'log-4'").select("log_path", *[(F.col(c) * 2).alias(c) for c in ("avg_events_per_hour", "avg_errors_per_hour", "p95_burst_size")])
    gone = spark.createDataFrame([("gone.log", 1.0, 2.0, 3.0)], twice.schema)
    return _rounded(state.upsert(twice.unionByName(gone).withColumn("sample_count", F.lit(7)), new))


@query("k AS (SELECT * FROM e WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-29 00:00:00') SELECT log_path, count(*) AS n, max(line_number) AS last_line FROM k GROUP BY log_path")
def last_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime


    kept = last(adapters.events(spark, sf_dir), datetime(2024, 1, 30), "1d")
    return kept.groupBy("log_path").agg(F.count(F.lit(1)).alias("n"), F.max("line_number").alias("last_line"))


@query("r AS (SELECT log_path, line_number, message, row_number() OVER (PARTITION BY log_path ORDER BY ts DESC, line_number DESC) AS n FROM e) SELECT log_path, line_number, message FROM r WHERE n <= 10")
def recent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = adapters.events(spark, sf_dir).select("log_path", F.col("ts").alias("ran_at"), F.col("line_number").alias("id"), "message")
    return state.recent(runs).select("log_path", F.col("id").alias("line_number"), "message")


@query(f"""WITH m AS (SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, {', '.join(f"regexp_matches(text, '(?i)\\b(?:{'|'.join(w)})\\b') AS {name}" for name, w in C.EVIDENCE.items())} FROM m""", base=False)
def category_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter("text IS NOT NULL")
    return m.select("conv_id", "turn", *[summary.supported(F.lit(name), F.col("text")).alias(name) for name in C.EVIDENCE])


@query("""WITH p AS (SELECT CAST(label AS VARCHAR) AS log_path, vec_id AS n, embedding AS v FROM embeddings)
SELECT a.log_path, a.n AS a, b.n AS b, round(list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]), 6) AS cosine FROM p a JOIN p b ON a.log_path = b.log_path AND a.n < b.n
WHERE list_cosine_similarity(a.v::DOUBLE[], b.v::DOUBLE[]) >= 0.3""", base=False)
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("string").alias("log_path"), F.col("vec_id").alias("n"), F.col("embedding").alias("vector"))
    return inference.similar_pairs(v, 0.3).withColumn("cosine", F.round("cosine", 6))


@query("""WITH t AS (SELECT doc_id, lower(text) AS low FROM documents)
SELECT CASE WHEN contains(low, 'license') THEN 'error' WHEN contains(low, 'the') OR contains(low, 'und') THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM t GROUP BY 1""", base=False)
def keyword_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(S.tiers(F.coalesce("text", F.lit("")), (["license"], "error"), (["the", "und"], "warning")).alias("severity")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def _access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` rendered as an access log, one line an event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "error", "500").when(F.col("event_type") == "signup", "404").otherwise("200")
    line = F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"), F.lit(" - - ["), F.date_format("t", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), F.col("event_type"), F.lit(' HTTP/1.1" '), status, F.lit(" "), F.col("event_id").cast("string"), F.lit(' "-" "agent"'))
    return e.select(F.lit("nginx/access.log").alias("log_path"), (F.col("event_id") + 1).alias("line_number"), line.alias("raw"))


@query("""SELECT event_id + 1 AS line_number, CAST(epoch_us(date_trunc('second', ts)) AS BIGINT) AS us,
 CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity,
 CAST(CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 ELSE 200 END AS INTEGER) AS http_status, concat('GET /', event_type, ' HTTP/1.1') AS message, concat('10.0.0.', user_id) AS client FROM events""", base=False)
def access_log_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = engine.parse(_access_lines(spark, sf_dir), "nginx-access")
    return windows.with_us(events).select("line_number", "us", "severity", "http_status", "message", F.col("extra")["client"].alias("client"))


def _rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` rendered as the lines of five logs of different formats. Times are rounded to the millisecond, halves away
    from zero, as DuckDB's epoch_ms does."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumn("t", F.timestamp_millis(F.expr("(t + IF(t < 0, -500, 500)) DIV 1000")))
    iso, bsd = F.date_format("t", "yyyy-MM-dd HH:mm:ss,SSS"), F.concat(F.date_format("t", "MMM "), F.lpad(F.date_format("t", "d"), 2, " "), F.date_format("t", " HH:mm:ss"))
    word = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    what = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), F.col("event_type"))
    n = F.col("event_id").cast("string")
    shapes = {
        "app.log": F.concat(iso, F.lit(" [main] "), word, F.lit(" a.b.Worker - "), what),
        "kv.log": F.concat(F.lit("ts="), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z level="), F.lower(word), F.lit(' msg="'), what, F.lit('"')),
        "sys.log": F.concat(bsd, F.lit(" host1 worker["), n, F.lit("]: "), what),
        "json.log": F.concat(F.lit('{"level":"'), F.lower(word), F.lit('","message":"'), what, F.lit('","timestamp":"'), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit('Z"}')),
        "cron.log": F.concat(bsd, F.lit(" host1 CRON["), n, F.lit("]: (root) CMD ("), what, F.lit(")")),
    }
    lines = F.array(*[F.struct(F.lit(k).alias("log_path"), v.alias("raw")) for k, v in shapes.items()])
    return e.select((F.col("event_id") + 1).alias("line_number"), F.explode(lines).alias("l")).select("l.log_path", "line_number", "l.raw")


_FORMATS_SQL = "(VALUES ('app.log', 'log4j'), ('kv.log', 'logfmt'), ('sys.log', 'syslog'), ('json.log', 'winston'), ('cron.log', 'cron')) AS v(log_path, format)"


@query(f"SELECT log_path, format FROM {_FORMATS_SQL}", base=False)
def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.detect(_rendered(spark, sf_dir))


@query(f"""SELECT log_path, CASE WHEN log_path IN ('sys.log', 'cron.log') THEN CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END
  WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'warning' ELSE 'info' END AS severity, count(*) AS n, CAST(max(event_id) + 1 AS BIGINT) AS last_line,
  count(DISTINCT epoch_ms(ts) // CASE WHEN log_path IN ('sys.log', 'cron.log') THEN 1000 ELSE 1 END) AS stamps
FROM events, {_FORMATS_SQL} GROUP BY ALL""", base=False)
def mixed_formats_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    formats = spark.createDataFrame([("app.log", "log4j"), ("kv.log", "logfmt"), ("sys.log", "syslog"), ("json.log", "winston"), ("cron.log", "cron")], "log_path string, format string")
    events = engine.parse_all(_rendered(spark, sf_dir), formats)
    return events.groupBy("log_path", "severity").agg(F.count(F.lit(1)).alias("n"), F.max("line_number").alias("last_line"), F.countDistinct("ts").alias("stamps"))


def _lines(spark: SparkSession, sf_dir: str, shapes: dict[str, list], heads: dict[str, list[str]] | None = None) -> DataFrame:
    """``events`` rendered as logs: each event gives a log the lines listed for it, behind the log's first lines."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    cells = []
    for log, shape in shapes.items():
        first = len((heads or {}).get(log, []))
        cells += [F.struct(F.lit(log).alias("log_path"), (F.col("event_id") * len(shape) + first + i + 1).alias("line_number"), line.alias("raw")) for i, line in enumerate(shape)]
    rows = e.select(F.explode(F.array(*cells)).alias("l")).select("l.*").filter("raw IS NOT NULL")
    if not heads:
        return rows
    top = [(log, n, line) for log, lines in heads.items() for n, line in enumerate(lines, 1)]
    return rows.unionByName(spark.createDataFrame(top, "log_path string, line_number long, raw string"))


def _events(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    """Detected, checked for coverage and parsed; what is kept is a row for each log."""
    formats = engine.covered(lines, engine.detect(lines).persist()).persist()
    parsed = windows.with_us(engine.parse_all(lines, formats))
    return parsed.select("log_path", "line_number", "us", "severity", "source", "message")


def _word(error: str, signup: str, other: str):
    return F.when(F.col("event_type") == "error", error).when(F.col("event_type") == "signup", signup).otherwise(other)


_US, _US_S = "epoch_us(ts)", "CAST(epoch_us(date_trunc('second', ts)) AS BIGINT)"
_US_MS = "epoch_us(date_trunc('milliseconds', ts))"


@query(f"""SELECT 'zeek/conn.log' AS log_path, event_id + 3 AS line_number, {_US_MS} AS us, CASE event_type WHEN 'error' THEN 'warning' ELSE 'info' END AS severity, 'zeek-conn' AS source,
  concat('tcp 10.0.0.', user_id, ' -> 10.1.1.1:443 [', CASE event_type WHEN 'error' THEN 'REJ' ELSE 'SF' END, ']') AS message FROM events
UNION ALL SELECT 'iis.log', event_id + 3, {_US_S}, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END, 'iis',
  concat('GET /', event_type, ' -> ', CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 ELSE 200 END) FROM events
UNION ALL SELECT 'cf.log', event_id + 2, {_US_S}, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END, 'cloudfront',
  concat('GET /', event_type, ' -> ', CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 404 ELSE 200 END) FROM events""", base=False)
def header_directed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns named by header lines: zeek, IIS and CloudFront logs."""
    status = _word("503", "404", "200")
    day, clock = F.date_format("t", "yyyy-MM-dd"), F.date_format("t", "HH:mm:ss")
    stamp = F.format_string("%d.%03d", F.unix_seconds("t"), F.pmod(F.unix_millis("t"), F.lit(1000)))
    host = F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"))
    shapes = {
        "zeek/conn.log": [F.concat_ws("\t", stamp, F.lit("C1"), host, F.lit("10.1.1.1"), F.lit("443"), F.lit("tcp"), _word("REJ", "SF", "SF"))],
        "iis.log": [F.concat_ws(" ", day, clock, F.lit("10.1.1.1 GET"), F.concat(F.lit("/"), "event_type"), status, F.lit("12"))],
        "cf.log": [F.concat_ws("\t", day, clock, F.lit("FRA2"), host, F.lit("GET"), F.concat(F.lit("/"), "event_type"), status)],
    }
    heads = {
        "zeek/conn.log": ["#path\tconn", "#fields\tts\tuid\tid.orig_h\tid.resp_h\tid.resp_p\tproto\tconn_state"],
        "iis.log": ["#Software: IIS", "#Fields: date time s-ip cs-method cs-uri-stem sc-status time-taken"],
        "cf.log": ["#Fields: date time x-edge-location c-ip cs-method cs-uri-stem sc-status"],
    }
    return _events(spark, sf_dir, _lines(spark, sf_dir, shapes, heads))


@query(f"""SELECT 'db/alert_x.log' AS log_path, event_id * 2 + 2 AS line_number, {_US} AS us, CASE event_type WHEN 'error' THEN 'critical' WHEN 'signup' THEN 'error' ELSE 'info' END AS severity, 'oracle' AS source,
  CASE event_type WHEN 'error' THEN concat('ORA-00600: internal error ', event_id) WHEN 'signup' THEN 'ORA-01555: snapshot too old' ELSE concat('ALTER DATABASE step ', event_id) END AS message FROM events
UNION ALL SELECT 'mysql-slow.log', event_id * 4 + 3, CASE WHEN event_type = 'view' THEN NULL ELSE {_US} END, CASE WHEN event_id % 9 >= 5 THEN 'error' ELSE 'warning' END, 'mysql',
  concat('Slow query ', event_id % 9, '.500s by ', CASE WHEN event_type = 'signup' THEN '?' ELSE concat('u', user_id, '@db1') END, ' (rows_examined=', event_id, ')') FROM events WHERE event_type <> 'view'""", base=False)
def carried_state_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that need earlier ones: Oracle alert logs, and MySQL slow-query blocks, some without their time or user."""
    n, iso = F.col("event_id").cast("string"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    said = F.when(F.col("event_type") == "error", F.concat(F.lit("ORA-00600: internal error "), n)).when(F.col("event_type") == "signup", "ORA-01555: snapshot too old").otherwise(F.concat(F.lit("ALTER DATABASE step "), n))
    time = F.when(F.col("event_type") != "view", F.concat(F.lit("# Time: "), iso, F.lit("Z")))
    user = F.when(F.col("event_type") != "signup", F.concat(F.lit("# User@Host: u"), F.col("user_id").cast("string"), F.lit(" @ db1 []")))
    took = F.concat(F.lit("# Query_time: "), (F.col("event_id") % 9).cast("string"), F.lit(".5  Lock_time: 0.1 Rows_sent: 1  Rows_examined: "), n)
    return _events(spark, sf_dir, _lines(spark, sf_dir, {"db/alert_x.log": [F.concat(iso, F.lit("Z")), said], "mysql-slow.log": [time, user, took, F.lit("SELECT 1;")]}))


@query(f"""SELECT 'app.log' AS log_path, event_id * 30 + 1 AS line_number, {_US_MS} AS us, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity, 'a.b.Worker' AS source,
  concat('did ', event_type, CASE WHEN event_type = 'error' THEN (SELECT string_agg(concat(chr(10), '  at frame ', i), '' ORDER BY i) FROM range(least(20, 1 + event_id % 25)) AS r(i)) ELSE '' END) AS message FROM events""", base=False)
def folded_tracebacks_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracebacks of up to 25 lines behind the errors of an application's log; 20 are stored."""
    line = F.concat(F.date_format("t", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" [main] "), _word("ERROR", "WARN", "INFO"), F.lit(" a.b.Worker - did "), F.col("event_type"))
    frames = [F.when((F.col("event_type") == "error") & (F.col("event_id") % 25 >= i), F.lit(f"  at frame {i}")) for i in range(29)]
    return _events(spark, sf_dir, _lines(spark, sf_dir, {"app.log": [line, *frames]}))


@query(f"""SELECT 'k.log' AS log_path, event_id + 1 AS line_number, {_US} AS us, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity, 'klog' AS source, concat('did ', event_type) AS message FROM events
UNION ALL SELECT 'redis.log', event_id + 1, {_US_MS}, CASE event_type WHEN 'error' THEN 'warning' WHEN 'signup' THEN 'info' ELSE 'debug' END, 'redis', concat('did ', event_type) FROM events
UNION ALL SELECT 'ids.log', event_id + 1, {_US}, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END, 'snort', concat('did ', event_type) FROM events
UNION ALL SELECT 'ase.log', event_id + 1, {_US_MS}, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'info' END, 'pingintelligence', concat('did ', event_type) FROM events""", base=False)
def short_stamps_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps without a year, with fractions, and with the day before the month."""
    did = F.concat(F.lit("did "), F.col("event_type"))
    shapes = {
        "k.log": [F.concat(_word("E", "W", "I"), F.date_format("t", "MMdd HH:mm:ss.SSSSSS"), F.lit("       1 main.go:12] "), did)],
        "redis.log": [F.concat(F.lit("12:M "), F.date_format("t", "dd MMM yyyy HH:mm:ss.SSS"), F.lit(" "), _word("#", "*", "."), F.lit(" "), did)],
        "ids.log": [F.concat(F.date_format("t", "MM/dd-HH:mm:ss.SSSSSS"), F.lit("  [**] [1:2:3] "), did, F.lit(" [**] [Priority: "), _word("1", "2", "3"), F.lit("] {TCP} 1.2.3.4:1 -> 5.6.7.8:2"))],
        "ase.log": [F.concat(F.lit("["), F.date_format("t", "EEE MMM d HH:mm:ss:SSS yyyy"), F.lit("] [thread:9] ["), _word("error", "warning", "info"), F.lit("] "), did)],
    }
    return _events(spark, sf_dir, _lines(spark, sf_dir, shapes))


@query("""WITH l AS (SELECT concat('log-', event_id % 10) AS log_path, event_id % 10 AS kind, row_number() OVER (PARTITION BY event_id % 10 ORDER BY event_id) AS n FROM events),
c AS (SELECT log_path, kind, count(*) AS lines, count(*) FILTER (n <= 20 OR n % 10 < kind) AS fit FROM l GROUP BY ALL)
SELECT log_path, CASE WHEN fit >= 0.6 * lines THEN 'log4j' ELSE 'generic' END AS format, lines AS parsed FROM c WHERE fit < 0.6 * lines UNION ALL SELECT log_path, 'log4j', fit FROM c WHERE fit >= 0.6 * lines""", base=False)
def coverage_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs that begin in one format, of which more or fewer later lines fit; the others are read as generic."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    rows = e.select((F.col("event_id") % 10).alias("kind"), (F.floor(F.col("event_id") / 10) + 1).cast("long").alias("line_number"), "t")
    fits = (F.col("line_number") <= 20) | (F.col("line_number") % 10 < F.col("kind"))
    good = F.concat(F.date_format("t", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" [main] INFO a.b.Worker - fine"))
    lines = rows.select(F.concat(F.lit("log-"), F.col("kind").cast("string")).alias("log_path"), "line_number", F.when(fits, good).otherwise("plain words").alias("raw"))
    formats = engine.covered(lines, engine.detect(lines).persist()).persist()
    counts = engine.parse_all(lines, formats).groupBy("log_path").agg(F.count(F.lit(1)).alias("parsed"))
    return formats.join(counts, "log_path").select("log_path", "format", "parsed")


@query("""SELECT count(*) AS events, CAST(sum(n) AS BIGINT) AS folded FROM (SELECT event_id, (SELECT count(*) FROM events y WHERE y.event_type <> 'error' AND y.event_id > x.event_id
  AND y.event_id < coalesce((SELECT min(z.event_id) FROM events z WHERE z.event_type = 'error' AND z.event_id > x.event_id), 1e18)) AS n FROM events x WHERE event_type = 'error')""", base=False)
def continuation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    lines = e.select(F.lit("a").alias("log_path"), (F.col("event_id") + 1).alias("line_number"), F.when(F.col("event_type") == "error", "ERROR x").otherwise("  at y").alias("raw"))
    out = fold(lines, F.col("raw").startswith("ERROR"), F.col("raw").startswith("  at"))
    return out.agg(F.count(F.lit(1)).alias("events"), F.sum("folded").alias("folded"))
