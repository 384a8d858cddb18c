"""The tables of a star schema as event frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Columns of an event frame, as SQL over ``events``: eight logs, levels and messages by type and number.
EVENTS = """
concat('log-', cast(user_id % 8 AS STRING)) AS log_path,
event_id + 1 AS line_number,
ts,
CASE WHEN event_type = 'error' AND value > 200 THEN 'critical' WHEN event_type = 'error' THEN 'error'
     WHEN event_type = 'signup' THEN 'warning' WHEN event_type = 'view' THEN 'debug' ELSE 'info' END AS severity,
CASE WHEN user_id % 3 = 0 THEN 'ufw' WHEN user_id % 3 = 1 THEN 'sshd' ELSE 'app' END AS source,
CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN concat('Failed password for user', cast(user_id AS STRING))
     WHEN event_type = 'error' AND event_id % 37 = 0 THEN 'Out of memory: killed process 7'
     WHEN event_type = 'error' AND event_id % 31 = 0 THEN 'write: No space left on device'
     WHEN event_type = 'signup' AND event_id % 29 = 0 THEN 'worker failed to start'
     ELSE concat(event_type, ' by user', cast(user_id AS STRING)) END AS message,
CASE WHEN event_type = 'click' THEN 'BLOCK' WHEN event_type = 'view' THEN 'allow' END AS action,
event_type IN ('purchase', 'view') AS is_squid,
CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'TCP_DENIED/403' WHEN event_type = 'purchase' THEN 'TCP_MISS/200' WHEN event_type = 'view' THEN 'TCP_HIT/200' END AS result_code,
CAST(CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 403 WHEN event_type = 'view' AND event_id % 7 = 0 THEN 407 ELSE 200 END AS INT) AS http_status,
CASE WHEN event_type = 'view' AND event_id % 11 = 0 THEN 'CONNECT' ELSE 'GET' END AS method,
CAST(CASE WHEN event_type = 'view' AND event_id % 11 = 0 THEN 1000 + event_id % 5 END AS INT) AS connect_port
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    raw = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return raw.selectExpr(*_columns())


def _columns() -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(EVENTS):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(EVENTS[start:i])
            start = i + 1
    return [x.strip() for x in (*out, EVENTS[start:])]
