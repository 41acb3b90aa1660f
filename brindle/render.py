"""Results as a text table, as JSON, and as lines for a file. These collect a bounded number of rows only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

WIDTH = 16
BUFFER = 8192
JSON_ROWS = 100


def shown(value: object) -> str:
    if value is None:
        return "NULL"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def _cell(text: str) -> str:
    return f"| {(text if len(text) <= WIDTH else text[: WIDTH - 3] + '...'):>{WIDTH}} "


def text_table(rows: DataFrame) -> str:
    """Columns 16 wide; what goes beyond the buffer is left out and marked."""
    total = rows.count()
    if not total:
        return "empty set\n"
    rule = ("+" + "-" * (WIDTH + 2)) * len(rows.columns) + "+\n"
    line = len(rule)
    fitting = max(0, (BUFFER - 4 * line) // line)
    lines = ["".join(_cell(shown(v)) for v in r) + "|\n" for r in rows.limit(fitting).collect()]
    head = rule + "".join(_cell(c) for c in rows.columns) + "|\n" + rule
    return head + "".join(lines) + (rule if total <= fitting else "... ...\n") + f"Total record(s): {total}\n"


def as_json(rows: DataFrame, message: str = "") -> str:
    data = [list(rows.columns), *([shown(v) for v in r] for r in rows.limit(JSON_ROWS).collect())]
    return json.dumps({"msg": message, "data": data, "total": rows.count()}, ensure_ascii=False)


def append_lines(rows: DataFrame, path: str) -> None:
    """A header line and a line per row, read from the cluster a partition at a time."""
    with open(path, "a", encoding="utf-8") as out:
        out.write("".join(f"| {c} " for c in rows.columns) + "|\n")
        for r in rows.toLocalIterator():
            out.write("".join(f"| {shown(v)} " for v in r) + "|\n")
