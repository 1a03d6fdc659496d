"""Small results as Markdown and JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

#: Rows of a report; it is read by people and formatted on the driver.
MOST_ROWS = 10_000


def _rows(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a report has at most {MOST_ROWS} rows")
    return sorted(rows, key=lambda r: [str(v) for v in r])


def markdown(df: DataFrame, title: str) -> str:
    """A heading and a table with the rows in order; null is a dash, numbers with fractions have four places."""
    show = lambda v: "–" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in _rows(df)]) + "\n"


def pretty_json(df: DataFrame) -> str:
    """The rows as a JSON list, keys sorted, two blanks of indent, a line end at the end."""
    return json.dumps([r.asDict(recursive=True) for r in _rows(df)], indent=2, sort_keys=True, ensure_ascii=False, default=str) + "\n"
