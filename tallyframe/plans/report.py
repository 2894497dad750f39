"""Reports from one-row aggregates, rendered on the driver."""

from __future__ import annotations

import html
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from ..functions.errors import CATEGORIES
from ..operators import aggregate

LABELS = {"success": "Success", "timeout": "Timeout", "api_error": "API Error", "invalid_output": "Invalid Output", "quality_below_threshold": "Low Quality", "other": "Other"}


def gather(results: DataFrame) -> dict[str, Any]:
    """Statistics, composite score and error counts of result rows as one mapping: three small rows reach the driver."""
    stats = aggregate.statistics(results).first()
    errors = {r["category"]: r["count"] for r in aggregate.error_histogram(results).collect()}  # six rows
    return {"statistics": stats.asDict() if stats else {}, "composite": aggregate.composite(results).first().asDict(), "errors": {c: errors.get(c, 0) for c in CATEGORIES}}


def sections(found: dict[str, Any], model: str, task: str, when: str = "") -> list[tuple[str, list[tuple[str, str]]]]:
    """Titles and rows of a report."""
    s, c = found["statistics"], found["composite"]
    g = lambda k: s.get(k) or 0
    return [
        ("Overview", [("Model", model), ("Task", task), *([("Generated", when)] if when else [])]),
        ("Results", [("Total Tasks", f"{g('num_tasks')}"), ("Success Rate", f"{g('success_rate') * 100:.1f}%"), ("Average Score", f"{g('mean_score') * 100:.1f}%"), ("Composite Score", f"{c['composite_score'] * 100:.1f}%"), ("Total Cost", f"${g('total_cost'):.4f}"), ("Avg Latency", f"{g('mean_latency'):.1f}s")]),
        ("Score Distribution", [(n, f"{g(k):.4f}") for n, k in (("Mean", "mean_score"), ("Median", "median_score"), ("Std Dev", "std_score"), ("Min", "min_score"), ("Max", "max_score"))]),
        ("Error Summary", [(LABELS[k], str(n)) for k, n in found["errors"].items()]),
    ]


def markdown(parts: list[tuple[str, list[tuple[str, str]]]], title: str = "Evaluation Report") -> str:
    body = [f"# {title}"]
    for name, rows in parts:
        body += ["", f"## {name}", "", "| Item | Value |", "|---|---|", *(f"| {k} | {v} |" for k, v in rows)]
    return "\n".join(body) + "\n"


def page(parts: list[tuple[str, list[tuple[str, str]]]], title: str = "Evaluation Report") -> str:
    """The same as an HTML page."""
    e = html.escape
    tables = "".join(f"<h2>{e(name)}</h2><table>{''.join(f'<tr><th>{e(k)}</th><td>{e(v)}</td></tr>' for k, v in rows)}</table>" for name, rows in parts)
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}</h1>{tables}</body></html>"


def of_aggregate(row: dict[str, Any]) -> list[tuple[str, list[tuple[str, str]]]]:
    """Sections of a saved aggregate, its metrics included."""
    g = lambda k: row.get(k) or 0
    parts = [
        ("Overview", [(n, str(row[k])) for n, k in (("Timestamp", "timestamp"), ("Task", "task_id"), ("Agent", "agent_name"), ("Model", "model")) if k in row]),
        ("Summary", [("Total Tasks", f"{g('total_tasks')}"), ("Successful", f"{g('successful_tasks')} ({g('success_rate') * 100:.1f}%)"), ("Average Score", f"{g('avg_score') * 100:.1f}%"), ("Total Cost", f"${g('total_cost'):.4f}"), ("Avg Time/Task", f"{g('avg_execution_time'):.1f}s")]),
    ]
    metrics = row.get("metrics_summary") or {}
    return parts + ([("Metrics", [(f"{n} {k}", f"{v.get(k, 0):.4f}") for n, v in metrics.items() for k in ("mean", "min", "max", "std")])] if metrics else [])


def plain(parts: list[tuple[str, list[tuple[str, str]]]]) -> str:
    """A block of text for a console."""
    lines = []
    for name, rows in parts:
        lines += [name.upper(), "-" * 40, *(f"{k + ':':<18}{v}" for k, v in rows), ""]
    return "\n".join(lines)


def answer(row: dict[str, Any], form: str = "text") -> str:
    """One provider's answer as text, Markdown or JSON; a failed one by its error."""
    if form == "json":
        return json.dumps(row, indent=2)
    title = f"## {row['provider']}" if form == "markdown" else row["provider"]
    if not row["success"]:
        return f"{title}: {row.get('error') or 'Unknown error'}\n"
    facts = [("Model", row["model"]), ("Latency", f"{row['latency']:.2f}s"), ("Cost", f"${row['cost']:.6f}"), ("Tokens", str(row["tokens"]))]
    if form == "markdown":
        return "\n".join([title, "", "| Item | Value |", "|---|---|", *(f"| {k} | {v} |" for k, v in facts), "", row["response"], ""])
    return "\n".join([title, *(f"  {k}: {v}" for k, v in facts), "", row["response"], ""])


def write(parts: list[tuple[str, list[tuple[str, str]]]], folder: str | Path, name: str, form: str = "both") -> list[Path]:
    """Write HTML, Markdown or both into a folder."""
    made = {"html": (".html", page), "markdown": (".md", markdown)}
    out = []
    Path(folder).mkdir(parents=True, exist_ok=True)
    for key in made if form == "both" else (form,):
        suffix, render = made[key]
        out.append(Path(folder) / f"{name}{suffix}")
        out[-1].write_text(render(parts), encoding="utf-8")
    return out
