"""Self-contained HTML reports with inline SVG bars."""

from __future__ import annotations

from collections.abc import Mapping
from html import escape

from pyspark.sql import DataFrame

ROWS = 200


def bars(values: list[tuple[str, float]], width: int = 420) -> str:
    """Horizontal bars around 0."""
    top = max((abs(v) for _, v in values), default=0) or 1
    rows = []
    for i, (label, v) in enumerate(values):
        w = abs(v) / top * width / 2
        x = width / 2 - (w if v < 0 else 0)
        rows.append(f'<text x="0" y="{i * 18 + 13}" font-size="11">{escape(label)}</text><rect x="{160 + x:.1f}" y="{i * 18 + 3}" width="{w:.1f}" height="12" fill="{"#b33" if v < 0 else "#37a"}"/><text x="{165 + width}" y="{i * 18 + 13}" font-size="11">{v:.3g}</text>')
    return f'<svg width="{width + 240}" height="{len(values) * 18 + 8}" xmlns="http://www.w3.org/2000/svg">{"".join(rows)}</svg>'


def render_tables(title: str, tables: Mapping[str, DataFrame]) -> str:
    """A page with the first rows of each table, and bars where a table has differences."""
    parts = [f"<!DOCTYPE html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(ROWS).collect()
        parts.append(f"<h2>{escape(name)}</h2>")
        if "difference" in df.columns and rows:
            label = next((c for c in ("candidate", "condition", "label") if c in df.columns), df.columns[0])
            parts.append(bars([(str(r[label]), float(r["difference"] or 0)) for r in rows]))
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
        parts.append(f"<table border=1 cellspacing=0><tr>{head}</tr>{body}</table>")
    return "".join(parts)
