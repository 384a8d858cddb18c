"""Reading logs: plain, gzip, bzip2 and UTF-16 files as (log_path, line_number, raw)."""

from __future__ import annotations

import bz2
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class PathError(ValueError):
    """A log path that may not be read."""


def check_path(path: str, allowed: list[str] | None = None, max_mb: int = 2048) -> str:
    """The resolved path of a readable regular file within the allowed folders."""
    found = Path(path).expanduser().resolve()
    if not found.exists():
        raise PathError(f"no such file: {path}")
    if not found.is_file():
        raise PathError(f"not a regular file: {path}")
    if allowed and not any(found.is_relative_to(Path(a).expanduser().resolve()) for a in allowed):
        raise PathError(f"not in an allowed folder: {path}")
    if found.stat().st_size > max_mb << 20:
        raise PathError(f"larger than {max_mb} MB: {path}")
    return str(found)


def unpack(data: bytes) -> tuple[bytes, str]:
    """Content of a gzip or bzip2 archive by its first bytes, as far as it is readable, and why not farther, if so."""
    if not _packed(data):
        return data, ""
    out, reason = [], ""
    while data:
        reader = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else bz2.BZ2Decompressor()
        at = 0
        try:
            while at < len(data) and not reader.eof:
                out.append(reader.decompress(data[at : at + (1 << 16)]))
                at += 1 << 16
        except (zlib.error, OSError, EOFError) as e:
            reason = str(e)
            break
        if not reader.eof:
            reason = "it ends early"
            break
        rest = reader.unused_data + data[at:]
        data = rest if _packed(rest) else b""
    return b"".join(out), reason


def _packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or data[:3] == b"BZh"


def readable(path: str) -> tuple[int, str]:
    """Of an archive that is cut off or broken: how many lines are left, and the reason; else the reason is empty."""
    with open(path, "rb") as f:
        if not _packed(f.read(3)):
            return 0, ""
        f.seek(0)
        data, reason = unpack(f.read())
    return (len(split_lines(decode(data))) if reason else 0), reason


def split_lines(text: str) -> list[str]:
    """Lines end at a line feed, a carriage return or both; other separators are part of a line."""
    lines = re.split(r"\r\n|\r|\n", text)
    return lines[:-1] if lines[-1] == "" else lines


def decode(data: bytes) -> str:
    """Text by byte order mark or by the share of NUL bytes; undecodable bytes are replaced."""
    head = data[:4096]
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    if head and head.count(0) > 0.25 * len(head):
        return data.decode("utf-16-le" if head[1::2].count(0) >= head[::2].count(0) else "utf-16-be", "replace")
    return data.decode("utf-8-sig", "replace")


def _lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            data, cut = unpack(content)
            lines = split_lines(decode(data))
            for at in range(0, len(lines), 50_000):
                part = lines[at : at + 50_000]
                yield pd.DataFrame({"log_path": path, "line_number": range(at + 1, at + 1 + len(part)), "raw": part, "cut": bool(cut)})


def read_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """(log_path, line_number, raw, cut) of whole files, in order; line numbers count blank lines. A file is read by one
    task, as its compression and encoding show only there; use ``read_plain`` for very large UTF-8 files."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInPandas(_lines, "log_path string, line_number bigint, raw string, cut boolean")


def read_plain(spark: SparkSession, *paths: str) -> DataFrame:
    """(log_path, line_number, raw) of UTF-8 files, split over many tasks; line numbers are those of the files. Lines are
    counted by split first, so a file of any size is numbered without going through one task."""
    rows = spark.read.text(list(paths)).select(F.input_file_name().alias("log_path"), F.input_file_block_start().alias("_at"), F.col("value").alias("raw"), F.monotonically_increasing_id().alias("_n"))
    ends = rows.groupBy(F.col("log_path").alias("_log"), F.col("_at").alias("_from")).agg(F.count(F.lit(1)).alias("_lines"), F.min("_n").alias("_first"))
    before = Window.partitionBy("_log").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.coalesce(F.sum("_lines").over(before), F.lit(0)))
    joined = rows.join(ends, (F.col("log_path") == F.col("_log")) & (F.col("_at") == F.col("_from")))
    return joined.select("log_path", (F.col("_before") + F.col("_n") - F.col("_first") + 1).alias("line_number"), "raw")
