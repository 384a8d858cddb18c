"""Detecting the format of each log and parsing its lines, as column expressions over (log_path, line_number, raw)."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.formats.catalog import ALIASES, BY_NAME, FORMATS
from timbrel.formats.columns import EVENT, cells, event
from timbrel.formats.spec import Format
from timbrel.formats.stateful import READERS, TRACEBACK, folded

SAMPLE_LINES = 20
SAMPLE_CHARS = 8192

_SYSLOG = r"^(?:<\d+>)?[A-Z][a-z]{2}\s+\d{1,2} \d\d:\d\d:\d\d \S+ [\w./()-]+(?:\[\d+\])?: "


def named(name: str) -> Format:
    """The format of a name or alias; ValueError with close names if there is none."""
    found = BY_NAME.get(ALIASES.get(name.lower(), name.lower()))
    if found is None:
        near = difflib.get_close_matches(name.lower(), [*BY_NAME, *ALIASES], 3)
        raise ValueError(f"unknown format {name!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))
    return found


def _gate(fmt: Format) -> Column:
    """Does a sample line look like the format?"""
    return F.col("_line").rlike(fmt.gate or fmt.pattern)


def _sum(counts: Column, more: Column) -> Column:
    return F.zip_with(counts, more, lambda a, b: a + b)


def detect(lines: DataFrame) -> DataFrame:
    """(log_path, format) of each log, from its first lines: at most SAMPLE_LINES rows of hits are gathered for a log, and
    the first format whose hits suffice is its format."""
    sample = lines.filter((F.col("line_number") <= SAMPLE_LINES) & (F.trim("raw") != "")).select("log_path", F.substring("raw", 1, SAMPLE_CHARS).alias("_line"))
    also = [f for f in FORMATS if f.also]
    line = F.col("_line")
    hits = F.array(line.rlike(_SYSLOG), line.rlike(TRACEBACK), *[_gate(f) for f in FORMATS], *[line.rlike(f.also) for f in also])
    rows = sample.select("log_path", F.transform(hits, lambda h: F.coalesce(h.cast("int"), F.lit(0))).alias("hits"))
    rows = rows.groupBy("log_path").agg(F.collect_list("hits").alias("hits"))
    zeros = F.array_repeat(F.lit(0), 2 + len(FORMATS) + len(also))
    rows = rows.select("log_path", F.size("hits").alias("all"), F.aggregate("hits", zeros, _sum).alias("n"))
    known = F.array(*[F.struct(F.lit(f.name).alias("name"), F.lit(f.share).alias("share"), F.lit(bool(f.tag)).alias("tag"), F.lit(f.path).alias("path"), F.lit(f.fold).alias("fold"), F.lit(2 + len(FORMATS) + also.index(f) if f.also else -1).alias("also")) for f in FORMATS])
    whole = F.col("log_path").rlike(r"(^|/)(messages|syslog)[^/]*$")

    def fits(f: Column, i: Column) -> Column:
        n = F.get("n", i + 2)
        # Half of the syslog lines, and not a log that holds all programs' lines.
        tagged = (n > 0) & (2 * n >= F.get("n", F.lit(0))) & ~whole
        # Continuation lines don't count where they belong to the event before.
        lines = F.col("all") - F.when(f["fold"], F.get("n", F.lit(1))).otherwise(0)
        enough = (n >= F.greatest(F.lit(1.0), f["share"] * lines)) & ((f["also"] < 0) | (F.get("n", f["also"]) > 0))
        named = (f["path"] != "") & (n > 0) & F.rlike(F.col("log_path"), F.concat(F.lit("(?i)"), f["path"]))
        return named | F.when(f["tag"], tagged).otherwise(enough)

    return rows.select("log_path", F.coalesce(F.get(F.filter(known, fits), F.lit(0))["name"], F.lit("generic")).alias("format"))


#: Formats that one pass over the lines reads; their expressions are one plan.
TOGETHER = 16


def _choice(formats: list[Format], make) -> Column:
    if len(formats) == 1:
        return make(formats[0])
    out = F.when(F.col("format") == formats[0].name, make(formats[0]))
    for f in formats[1:]:
        out = out.when(F.col("format") == f.name, make(f))
    return out


def _read(lines: DataFrame, formats: list[Format], year: int) -> DataFrame:
    """Events of ``lines`` (with ``format``, if there are several), and ``meta``: lines that belong to a format's structure
    and are no events. Lines that are neither are left out."""
    if formats[0].carry:
        rows, made, meta = READERS[formats[0].carry](lines.filter(F.trim("raw") != ""), formats[0], year)
        rows = rows.select("log_path", "line_number", "raw", made.alias("_event"), meta.alias("meta")).filter("meta OR _event IS NOT NULL")
    else:
        found = F.filter(F.array(_choice(formats, cells)), lambda c: c.isNotNull())
        # The generator keeps the optimizer from running a pattern once for the filter and once for the parts.
        rows = lines.filter(F.trim("raw") != "").select("*", F.explode(found).alias("_cells"))
        rows = rows.select("log_path", "line_number", "raw", _choice(formats, lambda f: event(f, year)).alias("_event"), F.lit(False).alias("meta"))
    events = rows.select("log_path", "line_number", "raw", "_event.*", "meta").select(*EVENT, "meta")
    return folded(lines, events, formats[0]) if formats[0].fold else events


def parse(lines: DataFrame, fmt: Format | str, year: int = 2024) -> DataFrame:
    """Events of ``lines`` in one format; lines that don't fit are left out. ``year`` is that of stamps without one."""
    return _read(lines, [named(fmt) if isinstance(fmt, str) else fmt], year).filter("NOT meta").drop("meta")


def _groups(lines: DataFrame, formats: DataFrame) -> Iterator[tuple[DataFrame, list[Format]]]:
    """The lines with their log's format: for TOGETHER plain formats at a time, and each format that carries state alone."""
    found = [named(r["format"]) for r in formats.select("format").distinct().orderBy("format").collect()] or [named("generic")]
    plain = [f for f in found if not f.carry and not f.fold]
    known = formats.select(F.col("log_path").alias("_log"), "format")
    for some in [plain[at : at + TOGETHER] for at in range(0, len(plain), TOGETHER)] + [[f] for f in found if f not in plain]:
        names = [n for f in some for n in (f.name, *[a for a, x in ALIASES.items() if x == f.name])]
        yield lines.join(known.filter(F.col("format").isin(names)), F.col("log_path") == F.col("_log")).drop("_log"), some


def read_all(lines: DataFrame, formats: DataFrame, year: int = 2024) -> DataFrame:
    """Events and ``meta`` lines of logs with known formats (log_path, format)."""
    return reduce(DataFrame.unionByName, [_read(rows, some, year) for rows, some in _groups(lines, formats)])


def parse_all(lines: DataFrame, formats: DataFrame, year: int = 2024) -> DataFrame:
    """Events of logs with known formats (log_path, format), in one pass over the lines for each TOGETHER formats."""
    return read_all(lines, formats, year).filter("NOT meta").drop("meta")


def covered(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """The formats, with ``generic`` for logs of which too few lines are events or structure; all lines with text are
    generic events."""
    text = lines.filter(F.trim("raw") != "").groupBy("log_path").agg(F.count(F.lit(1)).alias("n"))
    counts = read_all(lines, formats).groupBy("log_path").agg(F.count(F.lit(1)).alias("events")).withColumnRenamed("log_path", "_log")
    least = F.lit(named("generic").least)
    for f in FORMATS:
        if f.least != named("generic").least:
            least = F.when(F.col("format") == f.name, f.least).otherwise(least)
    joined = formats.join(text, "log_path", "left").join(counts, F.col("log_path") == F.col("_log"), "left")
    return joined.select("log_path", F.when(F.coalesce("events", F.lit(0)) < least * F.col("n"), "generic").otherwise(F.col("format")).alias("format"))
