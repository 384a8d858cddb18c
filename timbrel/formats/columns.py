"""A line's parts and its event, as column expressions of one format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timbrel.formats.spec import Format, by_level, stamp

EVENT = ["log_path", "line_number", "ts", "severity", "source", "message", "raw", "extra", "http_status", "connect_port", "result_code", "method", "action", "is_squid"]

#: Between the parts of a line and before the first; noncharacters, which texts don't hold.
_PART, _FIT = "\ufdd0", "\ufdd1"


def cells(fmt: Format) -> Column:
    """The parts of a line in one format, in order, or null where it doesn't fit. The pattern runs once."""
    raw = F.col("raw")
    if fmt.json:
        value = F.try_parse_json("raw")
        path = lambda p: "$" + "".join(f"['{k}']" for k in p.split("."))
        dotted = lambda p: f"$['{p}']"
        get = lambda v, p: F.coalesce(F.try_variant_get(v, dotted(p), "string"), F.try_variant_get(v, path(p), "string"))
        parts = lambda v: F.when(v.isNotNull(), F.array(*[F.coalesce(*[get(v, p) for p in paths]) for paths in fmt.json.values()]))
        return F.when(raw.rlike(fmt.gate), F.transform(F.array(value), parts)[0])
    marked = F.regexp_replace(raw, f"(?:{fmt.pattern})" + r"[\s\S]*", _FIT + _PART.join(f"${i}" for i in range(1, len(fmt.parts) + 1)))
    quick = F.transform(F.array(marked), lambda m: F.when(m.startswith(_FIT), F.split(F.substr(m, F.lit(2)), _PART)))[0]
    slow = F.when(raw.rlike(fmt.pattern), F.array(*[F.regexp_extract(raw, fmt.pattern, i) for i in range(1, len(fmt.parts) + 1)]))
    return F.when(raw.contains(_PART) | raw.startswith(_FIT), slow).otherwise(quick)


_KINDS = {"http_status": "int", "connect_port": "int", "result_code": "string", "method": "string", "action": "string", "is_squid": "boolean"}


def made(ts: Column, severity: Column, source: Column, message: Column, fields: dict[str, Column] | None = None, **more: Column) -> Column:
    """An event's fields but its log, line and text, as a struct; ``fields`` without nulls are its extra ones."""
    extra = F.create_map().cast("map<string,string>")
    if fields:
        extra = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[x.cast("string") for x in fields.values()])), lambda k, v: v.isNotNull())
    rest = {k: more.get(k, F.lit(False) if kind == "boolean" else F.lit(None)).cast(kind) for k, kind in _KINDS.items()}
    return F.struct(ts.alias("ts"), severity.alias("severity"), source.alias("source"), F.coalesce(message, F.lit("")).alias("message"), extra.alias("extra"), *[x.alias(k) for k, x in rest.items()])


def event(fmt: Format, year: int, found: str = "_cells") -> Column:
    """An event as a struct, from the column ``found`` of cells."""
    parts = list(fmt.json or fmt.parts)
    got = {k: F.nullif(F.get(found, F.lit(i)), F.lit("")) for i, k in enumerate(parts)}
    none = F.lit(None).cast("string")
    if "message" not in got:
        got["message"] = F.col("raw")
    if "bare" in got:
        got["message"] = F.coalesce(got["message"], got["bare"])
    when = stamp(fmt.time, got["ts"], year) if "ts" in got else F.lit(None).cast("timestamp_ntz")
    if "clock" in got and "date" not in got:  # a time of the day: of the first day of the year
        when = stamp("iso", F.concat(F.lit(f"{year}-01-01 "), got["clock"]), year)
    if "bsd" in got:
        when = F.coalesce(stamp("3164", got["bsd"], year), when)
    if "date" in got and "clock" in got:
        when = stamp("iso", F.concat_ws(" ", got["date"], got["clock"]), year)
    severity = fmt.severity(got) if fmt.severity else by_level(got, fmt)
    if fmt.json and not fmt.severity:
        status = got.get("http_status")
        if status is not None and "level" not in got:
            severity = F.when(status.try_cast("int") >= 500, "error").when(status.try_cast("int") >= 400, "warning").otherwise("info")
        if "error" in got:
            severity = F.when(got["error"].isNotNull() & (severity == "info"), "warning").otherwise(severity)
    squid = fmt.name == "squid"
    fields = {k: got[k] for k in parts if k not in ("ts", "message", "level", "source", "bsd", "bare")}
    port = F.when(F.upper(got["method"]) == "CONNECT", F.regexp_extract(got["message"], r":(\d+)$", 1).try_cast("int")) if squid else F.lit(None).cast("int")
    get = lambda k: got.get(k, none)
    source = F.coalesce(get("source"), F.lit("filterlog" if fmt.name == "pfsense" else fmt.name))
    if "ts" in got and not fmt.time.startswith("epoch"):
        fields["utc_offset"] = F.nullif(F.regexp_extract(got["ts"], r":\d\d(?:[.,]\d+)?\s?([+-]\d\d:?\d\d)$", 1), F.lit(""))
    return made(when, severity, source, got["message"], fields, http_status=get("http_status").try_cast("int"), connect_port=port, result_code=get("result_code"), method=get("method"), action=get("action"), is_squid=F.lit(squid))
