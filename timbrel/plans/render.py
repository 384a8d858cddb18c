"""A summary as text for a terminal."""

from __future__ import annotations

_COLORS = {"CRITICAL": "31", "WARNING": "33", "INFO": "34", "CLEAN": "32"}


def panel(row: dict, color: bool = True, remediation: bool = True, width: int = 100) -> str:
    """A box with the level and title, the findings, the confidence and what to do."""
    body = [f"● {f['headline']}" + (f"  ({f['detail']})" if f["detail"] else "") for f in row["findings"]]
    if row["confidence"] > 0:
        body.append(f"Confidence: {row['confidence']:.0%}")
    if row["remediation"] and remediation:
        body += ["", f"Remediation: {row['remediation']}"]
    lines = [part for text in body for part in ([text[i : i + width - 4] for i in range(0, len(text), width - 4)] or [""])]
    head = f"{row['level']}  {row['title']}"
    out = [f"┌─ {head} " + "─" * max(0, width - len(head) - 5) + "┐", *[f"│ {x:<{width - 4}} │" for x in lines], "└" + "─" * (width - 2) + "┘"]
    return "\n".join(f"\x1b[{_COLORS[row['level']]}m{x}\x1b[0m" if color else x for x in out)


def footer(row: dict, elapsed: float, version: str) -> str:
    """What was read, and what was not."""
    lost = f"  │  {row['skipped_count']:,} line(s) unparsed" if row["skipped_count"] else ""
    return f"Analyzed {row['parsed_count']:,} events of {row['log_path']} ({row['parser_format']}) in {elapsed:.1f}s  │  {row['signal_count']} incident(s){lost}  │  timbrel v{version}"
