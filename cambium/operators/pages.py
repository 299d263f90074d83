"""Reports for people: HTML pages and Markdown cards of small tables."""

from __future__ import annotations

from collections.abc import Mapping
from html import escape

from pyspark.sql import DataFrame


def shown(value: object) -> str:
    """A share as percent, another number in four digits, nothing as a dash."""
    if value is None:
        return "—"
    if isinstance(value, float):
        return f"{100 * value:.2f} %" if 0 <= value <= 1 else f"{value:.4g}"
    return str(value)


def html_page(title: str, tables: Mapping[str, DataFrame], rows: int = 1000) -> str:
    """Tables under their names, each as far as rows: a page for people, whose length is its feature."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{escape(c)}" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape(shown(v))}" for v in r) for r in df.limit(rows).collect())
        parts.append(f"<h2>{escape(name)}</h2><table><tr>{head}{body}</table>")
    return "\n".join(parts)


def card(title: str, tables: Mapping[str, DataFrame], rows: int = 100) -> str:
    """The same as Markdown."""
    parts = [f"# {title}"]
    for name, df in tables.items():
        lines = [" | ".join(df.columns), " | ".join("-" for _ in df.columns), *(" | ".join(shown(v).replace("|", "\\|") for v in r) for r in df.limit(rows).collect())]
        parts.append(f"## {name}\n\n" + "\n".join(f"| {x} |" for x in lines))
    return "\n\n".join(parts)
