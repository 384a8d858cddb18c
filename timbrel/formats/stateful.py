"""Formats whose lines need earlier ones of their log: headers that name columns, times on lines of their own, blocks of
comment lines, and continuation lines.

A value is carried from line to line inside buckets of lines; only each bucket's last value goes through a window of the
whole log, so a large log is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timbrel.formats.columns import cells, event, made
from timbrel.formats.spec import Format, by_level, stamp
from timbrel.functions.severity import http_status

# What continues an event, how many such lines are stored, and the lists of the header-directed formats.
TRACEBACK = r"^(?:\s+\S|Traceback \(most recent call last\):|Caused by: |Suppressed: |\.\.\. \d+ (?:more|common frames omitted)|[A-Za-z_][\w.]*(?:Error|Exception|Warning|Exit|Interrupt):?(?:\s|$))"
CONTINUED = 20
ZEEK_FIELDS = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service", "duration", "orig_bytes", "resp_bytes", "conn_state"]
ZEEK_BAD_STATES = ["S0", "REJ", "RSTO", "RSTR", "RSTOS0", "RSTRH", "SH", "SHR"]
ORACLE_CRITICAL = ["00600", "07445", "00603", "01578", "00204", "27300"]

#: Lines of a bucket.
BUCKET = 1 << 16


def carried(rows: DataFrame, values: dict[str, Column], behind: bool = False) -> DataFrame:
    """``rows`` (log_path, line_number, ...) with a column for each of ``values``: the last one that isn't null, of the lines
    up to this one, or of those before it."""
    names = list(values)
    rows = rows.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()], F.expr(f"line_number div {BUCKET}").alias("_bucket"))
    last = [F.max(F.when(F.col(f"_v_{n}").isNotNull(), F.struct("line_number", f"_v_{n}")))[f"_v_{n}"].alias(f"_e_{n}") for n in names]
    up_to = Window.partitionBy("_log").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(F.col("log_path").alias("_log"), F.col("_bucket").alias("_at")).agg(*last)
    ends = ends.select("_log", "_at", *[F.last(f"_e_{n}", ignorenulls=True).over(up_to).alias(f"_b_{n}") for n in names])
    inside = Window.partitionBy("log_path", "_bucket").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1 if behind else 0)
    joined = rows.join(ends, (F.col("log_path") == F.col("_log")) & (F.col("_bucket") == F.col("_at")))
    kept = [c for c in rows.columns if c != "_bucket" and c not in {f"_v_{n}" for n in names}]
    return joined.select(*kept, *[F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_b_{n}")).alias(n) for n in names])


def folded(lines: DataFrame, events: DataFrame, fmt: Format) -> DataFrame:
    """``events`` (with ``meta``) of ``lines`` in one format, with the continuation lines behind each in its message, the
    first CONTINUED of them; the continuation lines themselves are ``meta``. Other lines between are no part of it."""
    raw = F.col("raw")
    kind = F.when(raw.rlike(f"(?:{fmt.pattern})"), "event").when(raw.rlike(TRACEBACK), "more")
    rows = lines.filter(F.trim("raw") != "").select("log_path", "line_number", "raw", kind.alias("kind")).filter("kind IS NOT NULL")
    more = carried(rows, {"of": F.when(F.col("kind") == "event", F.col("line_number"))}).filter("kind = 'more' AND of IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("log_path", "of").orderBy("line_number"))
    kept = more.withColumn("place", place).filter(F.col("place") <= CONTINUED).groupBy(F.col("log_path").alias("_log"), F.col("of").alias("_of"))
    texts = kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "raw"))), lambda x: x["raw"]), "\n").alias("_more"))
    whole = events.join(texts, (F.col("log_path") == F.col("_log")) & (F.col("line_number") == F.col("_of")), "left")
    whole = whole.withColumn("message", F.concat_ws("\n", "message", "_more")).select(events.columns)
    none = {c: F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns}
    none |= {"log_path": F.col("log_path"), "line_number": F.col("line_number"), "raw": raw, "meta": F.lit(True).alias("meta")}
    return whole.unionByName(more.select(*none.values()))


def _at(fields: Column, values: Column):
    """The value of a named column, or null."""
    return lambda name: F.get(values, (F.array_position(fields, F.lit(name)) - 1).cast("int"))


def _zeek(lines: DataFrame, fmt: Format, year: int) -> tuple[DataFrame, Column, Column]:
    raw = F.col("raw")
    rows = carried(lines, {"_fields": F.when(raw.startswith("#fields"), raw), "_kind": F.when(raw.startswith("#path\t"), F.trim(F.get(F.split(raw, "\t"), F.lit(1))))})
    kind = F.coalesce("_kind", F.lit("conn"))
    fields = F.when(F.col("_fields").isNull(), F.array(*map(F.lit, ZEEK_FIELDS))).otherwise(F.slice(F.split("_fields", "\t"), 2, 10_000))
    get = _at(fields, F.split(raw, "\t"))
    state = F.nullif(get("conn_state"), F.lit(""))
    said = F.coalesce(*[F.nullif(get(n), F.lit("")) for n in ("msg", "note", "name")])
    flow = F.trim(F.concat(F.coalesce(get("proto"), get("service"), F.lit("")), F.lit(" "), F.coalesce(get("id.orig_h"), F.lit("?")), F.lit(" -> "), F.coalesce(get("id.resp_h"), F.lit("?")), F.lit(":"), F.coalesce(get("id.resp_p"), F.lit("?"))))
    severity = F.when(state.isin(ZEEK_BAD_STATES) | kind.isin("notice", "weird"), "warning").otherwise("info")
    message = F.coalesce(said, F.concat(flow, F.coalesce(F.concat(F.lit(" ["), state, F.lit("]")), F.lit(""))))
    ts = stamp("epoch", F.when(get("ts").rlike(r"^\s*\d+(\.\d+)?\s*$"), F.trim(get("ts"))), year)
    meta = raw.startswith("#")
    return rows, F.when(~meta, made(ts, severity, F.concat(F.lit("zeek-"), kind), message, {"zeek_log": kind, "uid": get("uid"), "conn_state": state})), meta


def _w3c(between: str, extra: dict[str, str]):
    """Lines under ``#Fields:`` headers."""

    def read(lines: DataFrame, fmt: Format, year: int) -> tuple[DataFrame, Column, Column]:
        raw = F.col("raw")
        rows = carried(lines, {"_fields": F.when(raw.startswith("#Fields:"), F.trim(F.substring(raw, 9, 1 << 20)))})
        fields = F.filter(F.split("_fields", r"\s+"), lambda x: x != "")
        values = F.split(F.trim(raw) if between != "\t" else raw, between)
        get = _at(fields, values)
        status = F.coalesce(get("sc-status").try_cast("int"), F.lit(0))
        message = F.trim(F.concat(F.coalesce(get("cs-method"), F.lit("")), F.lit(" "), F.coalesce(get("cs-uri-stem"), F.lit("")), F.lit(" -> "), status.cast("string")))
        fits = ~raw.startswith("#") & (F.size(fields) > 0) & (F.size(values) >= 2)
        ts = stamp("iso", F.concat(get("date"), F.lit(" "), get("time")), year)
        found = made(ts, http_status(status), F.lit(fmt.name), message, {"status": status, **{k: F.nullif(get(v), F.lit("")) for k, v in extra.items()}}, http_status=status)
        return rows, F.when(fits, found), raw.startswith("#")

    return read


def _oracle(lines: DataFrame, fmt: Format, year: int) -> tuple[DataFrame, Column, Column]:
    """Alert logs: a time stands on its own line and holds until the next one; one that can't be read takes it back."""
    raw = F.col("raw")
    meta = raw.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?[+\-Z]") & (F.length(F.trim("raw")) <= 40)
    rows = carried(lines, {"_time": F.when(meta, F.struct(stamp("iso", F.trim("raw"), year).alias("ts")))})
    code = F.regexp_extract(raw, r"\b(?:ORA|TNS)-(\d{4,5})\b", 1)
    severity = F.when(code.isin(ORACLE_CRITICAL), "critical").when(code != "", "error").when(raw.contains("Errors in file"), "warning").otherwise("info")
    fields = {"error_code": F.nullif(F.regexp_extract(raw, r"\b((?:ORA|TNS)-\d{4,5})\b", 1), F.lit(""))}
    return rows, F.when(~meta, made(F.col("_time.ts"), severity, F.lit("oracle"), F.trim("raw"), fields)), meta


def _mysql(lines: DataFrame, fmt: Format, year: int) -> tuple[DataFrame, Column, Column]:
    """Error lines, and slow-query blocks: the time and user lines since the last block, then the timing line, which is the
    event; the statement behind it belongs to the block."""
    raw, none = F.col("raw"), F.lit(None).cast("string")
    at, user = F.regexp_extract(raw, r"^# Time: (\S+)", 1), F.regexp_extract(raw, r"^# User@Host: (\S+) @ \S+", 1)
    host = F.regexp_extract(raw, r"^# User@Host: \S+ @ (\S+)", 1)
    timing = r"^# Query_time: ([\d.]+)\s+Lock_time: ([\d.]+)\s+Rows_sent: (\d+)\s+Rows_examined: (\d+)"
    slow = raw.rlike(timing)
    over = F.struct(none.alias("v"))
    values = {
        "_time": F.when(at != "", F.struct(at.alias("v"))).when(slow, over),
        "_user": F.when(user != "", F.struct(F.concat(user, F.lit("@"), host).alias("v"))).when(slow, over),
        "_body": F.when(at != "", F.lit(False)).when(slow, F.lit(True)),
    }
    rows = carried(lines, values, behind=True)
    rows = rows.withColumn("_cells", cells(fmt))
    part = lambda i: F.regexp_extract(raw, timing, i)
    took, who = part(1).try_cast("double"), F.coalesce("_user.v", F.lit("?"))
    message = F.concat(F.format_string("Slow query %.3fs by ", took), who, F.lit(" (rows_examined="), part(4), F.lit(")"))
    block = made(stamp("iso", F.col("_time.v"), year), F.when(took >= 5, "error").otherwise("warning"), F.lit("mysql"), message, {"query_time": part(1), "lock_time": part(2), "rows_sent": part(3), "rows_examined": part(4), "user": who})
    head = raw.startswith("SET timestamp=") | raw.startswith("use ") | (at != "") | (user != "")
    found = F.when(head, None).when(slow, block).when(F.col("_cells").isNotNull(), event(fmt, year))
    return rows, found, head | (~slow & F.col("_cells").isNull() & F.coalesce("_body", F.lit(False)))


def _kubernetes(lines: DataFrame, fmt: Format, year: int) -> tuple[DataFrame, Column, Column]:
    """Pod logs: container runtime lines, or the older JSON lines."""
    from timbrel.formats.catalog import BY_NAME

    first, second = BY_NAME["cri"], BY_NAME["docker"]
    rows = lines.withColumn("_cri", cells(first)).withColumn("_docker", F.when(F.col("_cri").isNull(), cells(second)))
    both = [event(f, year, f"_{f.name}").withField("source", F.lit("kubernetes")) for f in (first, second)]
    return rows, F.when(F.col("_cri").isNotNull(), both[0]).when(F.col("_docker").isNotNull(), both[1]), F.lit(False)


def _pingdirectory(lines: DataFrame, fmt: Format, year: int) -> tuple[DataFrame, Column, Column]:
    """Server lines with category and severity, and access lines with an operation."""
    raw, rest = F.col("raw"), F.col("_cells")[4]
    rows = lines.withColumn("_cells", cells(fmt))
    ts = stamp("clf", F.col("_cells")[0], year)
    said = F.coalesce(F.nullif(F.regexp_extract(rest, r'\bmsg="(.*)"\s*$', 1), F.lit("")), F.nullif(F.regexp_extract(rest, r"\bmsg=([^\"].*)$", 1), F.lit("")), rest)
    category, code = F.col("_cells")[1], F.nullif(F.regexp_extract(raw, r"\bresultCode=(\d+)", 1), F.lit(""))
    word = {"level": F.col("_cells")[2]}
    server = made(ts, by_level(word, fmt), F.when(F.upper(category) == "SYNC", "pingdatasync").otherwise("pingdirectory"), F.trim(said), {"category": category, "severity": F.lower(word["level"]), "msgID": F.col("_cells")[3], "pipe": F.nullif(F.regexp_extract(rest, r'\bpipe="?([^"\s]+)"?', 1), F.lit(""))})
    operation = F.col("_cells")[5]
    access = made(ts, F.when(code != "0", "warning").otherwise("info"), F.lit("pingdirectory"), F.trim(F.concat(operation, F.col("_cells")[6])), {"operation": operation, "resultCode": code})
    return rows, F.when(F.col("_cells").isNull(), None).when(category != "", server).otherwise(access), F.lit(False)


READERS = {
    "zeek": _zeek,
    "iis": _w3c(r"\s+", {"client": "c-ip", "time_taken_ms": "time-taken"}),
    "cloudfront": _w3c("\t", {"client": "c-ip", "edge": "x-edge-location", "result": "x-edge-result-type"}),
    "oracle": _oracle,
    "mysql": _mysql,
    "kubernetes": _kubernetes,
    "pingdirectory": _pingdirectory,
}
