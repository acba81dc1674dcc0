"""Binning numeric columns.  Edges take one driver round trip for all columns; rows then get a CASE expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridsmith.columns import is_numeric, resolve_list
from gridsmith.errors import InvalidArgument
from gridsmith.frame import Table, quoted
from gridsmith.plans import quantiles

EPSILON = 1e-10


def parse_bins(spec: str | int | list[float]) -> int | list[float]:
    """A number of bins, or sorted edges."""
    if isinstance(spec, (int, float)):
        spec = str(int(spec))
    items = [str(s).strip() for s in (spec.split(",") if isinstance(spec, str) else spec)]
    try:
        if len(items) == 1:
            n = int(items[0])
            if n <= 0:
                raise InvalidArgument("Number of bins must be greater than 0")
            return n
        edges = sorted(float(i) for i in items)
    except ValueError as e:
        if isinstance(e, InvalidArgument):
            raise
        raise InvalidArgument(f"Invalid bins {spec!r}") from None
    return edges


def assign(value: Column, edges: list[float], labels: list[str] | None, other: str | None) -> Column:
    """The label of the bin [lo, hi) of a value; the last bin is closed."""
    if len(edges) < 2:
        edges = [edges[0], edges[0]] if edges else [0.0, 0.0]
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        last = i == len(edges) - 2
        inside = (value >= lo) & ((value <= hi) if last else (value < hi))
        text = F.lit(labels[i] if labels else f"[{lo:.2f}, {hi:.2f})")
        out = (F if out is None else out).when(inside, text)
    return out.otherwise(F.lit(other))


def bin_columns(table: Table, columns: str, bins: str | int = 10, method: str = "equal-width", labels: str | list[str] | None = None, suffix: str = "_binned", drop_original: bool = False, include_lowest: bool = False, other_label: str | None = "NULL") -> Table:
    """``equal-width``, ``equal-frequency`` or ``custom`` bins of each column, as new columns after the others."""
    names = resolve_list(table.columns, columns)
    for n in names:
        if not is_numeric(table.schema[n].dataType):
            raise InvalidArgument(f"Column {n!r} must be numeric for binning")
    if method not in ("equal-width", "equal-frequency", "custom"):
        raise InvalidArgument(f"Unknown binning method {method!r}")
    want = parse_bins(bins)
    if method == "custom" and isinstance(want, int):
        raise InvalidArgument("Custom binning needs explicit edges")
    texts = [x.strip() for x in labels.split(",")] if isinstance(labels, str) else labels
    count = want if isinstance(want, int) else len(want) - 1
    if texts and len(texts) != count:
        raise InvalidArgument(f"Number of labels ({len(texts)}) must match number of bins ({count})")
    edges: dict[str, list[float]] = {}
    if isinstance(want, int):
        c = {n: quoted(n).cast("double") for n in names}
        if method == "equal-width":
            got = table.rows.agg(*[f(c[n]).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("lo", F.min), ("hi", F.max))]).first()
            for i, n in enumerate(names):
                lo, hi = got[f"lo{i}"], got[f"hi{i}"]
                edges[n] = [] if lo is None else [lo + (hi - lo) * k / want for k in range(want)] + [hi]
        else:
            got = quantiles.row_of(table.rows, [c[n] for n in names], [k / want for k in range(want + 1)]).first()
            for i, n in enumerate(names):
                edges[n] = sorted(set(got[f"q{i}"] or []))
    else:
        edges = {n: list(want) for n in names}
    if include_lowest:
        edges = {n: [e[0] - EPSILON, *e[1:]] if e else e for n, e in edges.items()}
    new = []
    for n in names:
        if f"{n}{suffix}" in table.columns:
            raise InvalidArgument(f"Column {n + suffix!r} already exists")
        own = texts if texts and len(texts) == max(1, len(edges[n]) - 1) else None
        new.append((assign(quoted(n), edges[n], own, other_label) if edges[n] else F.lit(other_label)).alias(f"{n}{suffix}"))
    kept = [quoted(c) for c in table.columns if not (drop_original and c in names)]
    return table.select(*kept, *new)
