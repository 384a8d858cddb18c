"""python -m timbrel [FILE...]: one summary for each log, or for standard input. Exit code 0 clean, 3 warning, 4 critical,
1 usage or settings, 2 path or archive."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
import time
from dataclasses import replace
from datetime import datetime, timezone
from pathlib import Path

from timbrel import __version__
from timbrel import config as settings
from timbrel.formats import engine
from timbrel.operators.lines import duration
from timbrel.plans.render import footer, panel
from timbrel.plans.summary import exit_code
from timbrel.sources.text import PathError, check_path, readable

STDIN = "<stdin>"


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("timbrel", description="Summarise incidents in logs.")
    parser.add_argument("files", nargs="*", help="log files; standard input without any")
    parser.add_argument("--format", help="read all files in this format")
    parser.add_argument("--last", help="only events of the last span, such as 90m or 2d")
    parser.add_argument("--threshold", type=float, help="least confidence of the model, 0 to 1")
    parser.add_argument("--no-baseline", action="store_true", help="don't compare with earlier runs")
    parser.add_argument("--year", type=int, default=None, help="the year of stamps without one")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--config")
    parser.add_argument("-v", "--verbose", action="store_true", help="name each log's format on standard error")
    parser.add_argument("-V", "--version", action="version", version=f"timbrel v{__version__}")
    return parser


def _say(text: str) -> None:
    print(f"timbrel: {text}", file=sys.stderr)


def main(argv: list[str] | None = None) -> int:
    try:
        args = _parser().parse_args(argv)
    except SystemExit as e:
        return 0 if not e.code else 1
    try:
        config = settings.load(args.config)
        if args.threshold is not None:
            if not 0 <= args.threshold <= 1:
                raise ValueError("--threshold is out of range")
            config = replace(config, inference=replace(config.inference, threshold=args.threshold))
        if args.format:
            engine.named(args.format)
        if args.last:
            duration(args.last)
        if not args.files and sys.stdin.isatty():
            raise ValueError("no file, and standard input is a terminal")
        paths = [check_path(p, list(config.security.allowed_log_paths), config.security.max_file_size_mb) for p in args.files]
        for path in paths:
            lost, reason = readable(path)
            if reason:
                _say(f"{path} is cut off or broken ({reason}); " + (f"analysing the {lost} recovered line(s)" if lost else "nothing is readable"))
            if reason and not lost:
                return 2
    except PathError as e:
        _say(str(e))
        return 2
    except ValueError as e:
        _say(str(e))
        return 1
    with tempfile.TemporaryDirectory() as folder:
        if not paths:
            Path(folder, "stdin").write_bytes(sys.stdin.buffer.read())
            paths = [str(Path(folder, "stdin"))]
        return _run(args, config, paths, "" if args.files else folder)


def _run(args: argparse.Namespace, config: settings.Config, paths: list[str], stdin: str) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from timbrel.plans import state
    from timbrel.plans.analysis import analyse
    from timbrel.sources.text import read_logs

    began, now = time.time(), datetime.now(timezone.utc).replace(tzinfo=None)
    spark = SparkSession.builder.appName("timbrel").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    lines = read_logs(spark, *paths).withColumn("log_path", F.regexp_replace("log_path", "^file:/*", "/"))
    if stdin:
        lines = lines.withColumn("log_path", F.lit(STDIN))
    lines = lines.cache()
    store = None
    try:
        store = state.Store(spark, config.state.path)
    except Exception as e:  # noqa: BLE001  an analysis without its state is worth more than none
        _say(f"state is not available: {e}")
    baselines = store.baselines() if store and not args.no_baseline else None
    done = analyse(lines, config, args.format, args.last, now, args.year or now.year, baselines)
    summaries = done.summaries.cache()
    rows = [r.asDict(recursive=True) for r in summaries.orderBy("log_path").collect()]
    elapsed = time.time() - began
    if store:
        try:
            store.append(state.history(summaries, now, elapsed))
            store.update(state.metrics(done.events), summaries, config.state.baseline_alpha, now)
        except Exception as e:  # noqa: BLE001
            _say(f"state was not updated: {e}")
    for frame in (lines, summaries):
        frame.unpersist()
    done.release()
    for row in rows:
        if args.verbose:
            _say(f"{row['log_path']} is read as {row['parser_format']}")
        if args.json:
            print(json.dumps(row, indent=2, ensure_ascii=False, default=str))
        else:
            print(panel(row, config.output.color and sys.stdout.isatty(), config.output.show_remediation))
            print(footer(row, elapsed, __version__))
    return max((exit_code(r["level"]) for r in rows), default=0)


if __name__ == "__main__":
    sys.exit(main())
