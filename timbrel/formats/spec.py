"""A format as data: how a line looks, what its parts are, how its time and severity are read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from timbrel.functions import severity as S

#: Stamp kinds: patterns for try_to_timestamp; the text is first put into the form they expect.
STAMPS = {
    "iso": None,
    "clf": "dd/MMM/yyyy:HH:mm:ss",
    "3164": "MMM d HH:mm:ss",
    "monthday": "MM/dd-HH:mm:ss",
    "klog": "MMdd HH:mm:ss",
    "day_month": "d MMM yyyy HH:mm:ss",
    "slash": "yyyy/MM/dd HH:mm:ss",
    "ctime": "MMM d HH:mm:ss yyyy",
    "dmy": "dd-MMM-yyyy HH:mm:ss",
    "dmy_slash": "dd/MMM/yyyy HH:mm:ss",
    "compact": "yyMMdd HH:mm:ss",
    "compact6": "yyMMdd HHmmss",
    "digits": "yyyyMMddHHmmss",
    "colon": "yyyyMMdd:HHmmss",
    "dotted": "yyyy.MM.dd HH:mm:ss",
    "short": "yy/MM/dd HH:mm:ss",
}


def stamp(kind: str, text: Column, year: int) -> Column:
    """Wall-clock time (TIMESTAMP_NTZ) of a text; null where it isn't one. An offset is dropped, epochs are UTC. Fractions
    of a second are kept to the microsecond."""
    if kind.startswith("epoch"):
        scale = {"epoch": 6, "epoch_ms": 3, "epoch_us": 0, "epoch_ns": -3}[kind]
        return F.expr("timestamp_micros(0)").cast("timestamp_ntz") + F.make_dt_interval(secs=(text.try_cast("decimal(38,9)") * F.lit(10.0**scale).cast("decimal(20,9)") / 1_000_000).cast("decimal(18,6)"))
    if kind == "iso":
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ",", "."), r"(?<=:\d\d(\.\d{1,9})?)\s?(?:Z|UTC|GMT|[A-Z]{3,4}|[+-]\d\d:?\d\d)$", ""), r"(\.\d{6})\d+", "$1")
        return bare.try_cast("timestamp_ntz")
    plain = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"(:\d\d:\d\d)(?:[.,]\d{1,9}|:\d{3})(?!\d)", "$1")
    pattern = STAMPS[kind]
    if kind == "clf":
        plain = F.regexp_replace(plain, r"\s*[+-]\d{4}$", "")
    if kind == "day_month":
        plain = F.regexp_replace(plain, r"^(\d{1,2} [A-Z][a-z]{2}) (?=\d\d:)", f"$1 {year} ")
    if kind == "ctime":
        plain = F.regexp_replace(plain, r"^[A-Z][a-z]{2} ", "")
    if "yy" not in pattern:
        plain, pattern = F.concat(F.lit(f"{year} "), plain), "yyyy " + pattern
    whole = F.try_to_timestamp(plain, F.lit(pattern)).cast("timestamp_ntz")
    part = F.nullif(F.regexp_replace(F.regexp_extract(text, r":\d\d:\d\d([.,]\d{1,9}|:\d{3})(?!\d)", 1), "^.", ""), F.lit(""))
    micros = F.rpad(F.substring(part, 1, 6), 6, "0").cast("decimal(18,6)") / 1_000_000
    return F.when(part.isNull(), whole).otherwise(whole + F.make_dt_interval(secs=micros.cast("decimal(18,6)")))


@dataclass(frozen=True)
class Format:
    """``pattern`` has the groups that ``parts`` names: ts, level, message, source, or any extra. ``json``: paths of the
    parts instead. ``gate``: what a sample line must look like (the pattern, if none). ``share``: the least share of the
    sample's lines that must, 0 for any one. ``also``: what another line must look like, too. ``path``: what a log's path may
    look like instead. ``fold``: continuation lines belong to the event before. ``carry``: the reader of a format whose
    lines need earlier ones. ``least``: the share of lines below which a log is read as generic."""

    name: str
    pattern: str = ""
    parts: tuple[str, ...] = ()
    json: dict[str, tuple[str, ...]] = field(default_factory=dict)
    time: str = "iso"
    gate: str = ""
    path: str = ""
    share: float = 0.0
    tag: str = ""
    severity: Callable[[dict[str, Column]], Column] | None = None
    levels: dict[str, str] = field(default_factory=dict)
    default: str = "info"
    also: str = ""
    fold: bool = False
    carry: str = ""
    least: float = 0.6


def by_level(parts: dict[str, Column], fmt: Format) -> Column:
    """Severity from the level part: the format's own words first."""
    word = parts.get("level")
    if word is None:
        return F.lit(fmt.default)
    out = S.level(word, fmt.default)
    for key, value in fmt.levels.items():
        out = F.when(F.lower(F.trim(word)) == key.lower(), value).otherwise(out)
    return out
