"""Text for consoles: cards, JSON arrays and correlation matrices, written row by row."""

from __future__ import annotations

import shutil
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

from gridsmith.errors import InvalidArgument
from gridsmith.sources.files import json_lines


def number(v: float) -> str:
    return f"{v:.2e}" if v and abs(v) < 0.001 else f"{v:.3f}"


def value(v) -> str:
    if v is None:
        return "NULL"
    return number(v) if isinstance(v, float) else str(v)


def width() -> int:
    return max(60, min(200, shutil.get_terminal_size((120, 24)).columns))


def card_lines(rows: Iterable[dict]) -> Iterator[str]:
    """The lines of one bordered card a row, and the number of rows."""
    w, i = width(), 0
    for i, row in enumerate(rows, 1):
        yield "┌" + f" Record {i} ".center(w - 2, "─") + "┐"
        pad = max(map(len, row), default=0)
        for k, v in row.items():
            text = f" {k.ljust(pad)} : {value(v)}"
            for at in range(0, max(1, len(text)), w - 3):
                yield "│" + text[at : at + w - 3].ljust(w - 2) + "│"
        yield "└" + "─" * (w - 2) + "┘"
    yield f"Total records: {i}"


def cards(rows: Iterable[dict]) -> str:
    return "\n".join(card_lines(rows))


def matrix(rows: list[dict]) -> str:
    head = ["", *[k.removeprefix("corr_with_") for k in rows[0] if k != "variable"]] if rows else []
    lines = [head] + [[r["variable"], *[value(v) if v is None else f"{v:.3f}" for k, v in r.items() if k != "variable"]] for r in rows]
    pad = [max(len(x[i]) for x in lines) for i in range(len(head))]
    return "\n".join("  ".join(c.rjust(p) for c, p in zip(x, pad, strict=True)) for x in lines)


def lines(df: DataFrame, fmt: str | None = None) -> Iterator[str]:
    """``df`` for the console, all its rows; the driver holds one partition at a time."""
    if fmt in ("csv", "parquet", "xlsx"):
        raise InvalidArgument(f"Format {fmt} needs an output file")
    rows = (r.asDict() for r in df.toLocalIterator(prefetchPartitions=False))
    if fmt == "json":
        yield from json_lines(rows)
    elif "variable" in df.columns and all(k == "variable" or k.startswith("corr_with_") for k in df.columns) and (all_rows := list(rows)):
        yield matrix(all_rows)
    else:
        yield from card_lines(rows)
