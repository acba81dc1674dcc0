"""Command line: ``python -m gridsmith.cli COMMAND INPUT [options]``.

Each command reads a file, applies one operator and prints the result or writes
it with ``-o``.  Errors go to standard error with exit code 1.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from gridsmith import display
from gridsmith.errors import GridError, InvalidArgument
from gridsmith.frame import Table
from gridsmith.operators import binning, correlation, dedup, filling, filtering, joining, outliers, projection, sampling, sizes, sorting, summaries
from gridsmith.session import session
from gridsmith.sources import files, footer

log = logging.getLogger("gridsmith")


def _rows_or_columns(t, a, by_column, by_row):
    if not a.columns and not a.rows:
        raise InvalidArgument("Either columns or rows must be specified")
    if a.rows:
        t = by_row(t, a.rows)
    return by_column(t, a.columns) if a.columns else t


def _filter(t, a):
    if not a.columns and not a.rows:
        raise InvalidArgument("Either columns or rows must be specified")
    t = filtering.filter_where(t, a.columns) if a.columns else t
    return filtering.filter_rows(t, a.rows) if a.rows else t


def _dedup(t, a):
    if a.row_wise == a.col_wise:
        raise InvalidArgument("Must specify either --row-wise or --col-wise")
    return (dedup.dedup_rows if a.row_wise else dedup.dedup_columns)(t, a.columns, a.keep)


def _correlations(t, a):
    if a.matrix:
        return correlation.matrix(t, a.columns, a.type, a.digits)
    return correlation.correlations(t, a.columns, a.type, a.digits, a.tests is not None)


def _outliers(t, a):
    how = {"iqr_multiplier": a.iqr_multiplier, "threshold": a.z_score_threshold}
    if a.remove:
        return outliers.remove(t, a.columns, a.method, **how)
    return outliers.detect(t, a.columns, a.method, show_values=a.show_values, row_numbers=a.include_row_numbers, **how)


def _sort(t, a):
    return sorting.sort(t, a.columns, a.strategy.split(","), a.descending.split(","), a.nulls, a.date_format, a.hour_format, a.case_insensitive)


def _merge(t, a):
    how = "left" if a.left_join else "right" if a.right_join else "inner"
    return joining.merge(t, files.read(t.rows.sparkSession, a.right), a.key, a.key_mapping, how)


def _append(t, a):
    return joining.append([t, *[files.read(t.rows.sparkSession, f.strip()) for f in a.files.split(",")]], a.ignore_schema)


def _split(t, a):
    ext = a.format or os.path.splitext(a.input)[1].lstrip(".") or "parquet"
    parts = sampling.split(t, a.ratio, a.stratified_by, a.random)
    for name, part in zip(sampling.split_names(len(parts), a.names, a.splits_prefix, ext), parts, strict=True):
        files.write(part, os.path.join(a.output_dir, name), single_file=True)
    return None


def _size(t, a):
    on_disk = os.path.getsize(a.input) if os.path.isfile(a.input) else None
    return sizes.size(t, a.columns, a.rows, a.bits, on_disk)


def _search(t, a):
    return (filtering.search_positions if a.rows else filtering.search)(t, a.value, a.columns, a.ignore_case, a.exact)


def _create(t, a):
    if not a.column and not a.row:
        raise InvalidArgument("Either --column or --row must be specified")
    return projection.create(t, a.column, a.row, a.int_division, a.zero_division)


#: command: (what it does, function of table and arguments, its options)
O = lambda *names, **kw: (names, kw)  # noqa: E731, E741
FLAG = {"action": "store_true"}
COMMANDS = {
    "head": ("First rows", lambda t, a: filtering.head(t, a.number), [O("-n", "--number", type=int, default=5)]),
    "tail": ("Last rows", lambda t, a: filtering.tail(t, a.number), [O("-n", "--number", type=int, default=5)]),
    "preview": ("Random rows in file order", lambda t, a: sampling.preview(t, a.number, a.random), [O("-n", "--number", type=int, default=5)]),
    "headers": ("Column names", lambda t, a: projection.headers(t, a.filter), [O("--filter")]),
    "schema": ("Column types", lambda t, a: projection.schema(t), []),
    "count": ("Number of rows", lambda t, a: summaries.count_rows(t), []),
    "size": ("Estimated sizes", _size, [O("-c", "--columns", **FLAG), O("-r", "--rows", **FLAG), O("--bits", **FLAG)]),
    "metadata": ("Parquet footer", None, [O("--schema", **FLAG), O("--row-groups", **FLAG), O("--column-chunks", **FLAG), O("--compression", **FLAG), O("--encoding", **FLAG), O("--statistics", **FLAG), O("--all", **FLAG), O("--detailed", **FLAG)]),
    "stats": ("Column statistics", lambda t, a: summaries.stats(t, a.columns, a.stats_type), [O("-c", "--columns"), O("-t", "--stats-type", default="basic")]),
    "correlations": ("Correlations", _correlations, [O("-c", "--columns"), O("-t", "--type", default="pearson"), O("--matrix", **FLAG), O("--tests"), O("--digits", type=int, default=4)]),
    "frequency": ("Counts of values", lambda t, a: summaries.frequency(t, a.columns, percentage=not (a.output or a.format)), [O("-c", "--columns", required=True)]),
    "outliers": ("Outlying values", _outliers, [O("-c", "--columns"), O("-m", "--method", default="iqr"), O("--iqr-multiplier", type=float, default=1.5), O("--z-score-threshold", type=float, default=3.0), O("--show-values", **FLAG), O("--include-row-numbers", **FLAG), O("--remove", **FLAG)]),
    "select": ("Choose columns or rows", lambda t, a: _rows_or_columns(t, a, projection.select_columns, filtering.select_rows), [O("-c", "--columns"), O("-r", "--rows")]),
    "drop": ("Drop columns or rows", lambda t, a: _rows_or_columns(t, a, projection.drop_columns, filtering.drop_rows), [O("-c", "--columns"), O("-r", "--rows")]),
    "fill": ("Fill missing values", lambda t, a: filling.fill(t, a.method, a.value, a.columns), [O("--method", default="value"), O("--value"), O("-c", "--columns")]),
    "filter": ("Rows by conditions", _filter, [O("-c", "--columns"), O("-r", "--rows")]),
    "search": ("Rows with a value", _search, [O("--value", required=True), O("-c", "--columns"), O("-r", "--rows", **FLAG), O("--ignore-case", **FLAG), O("--exact", **FLAG)]),
    "rename": ("Rename columns", lambda t, a: projection.rename(t, a.columns), [O("-c", "--columns", required=True)]),
    "create": ("New columns", _create, [O("-c", "--column"), O("-r", "--row"), O("--int-division", choices=["double", "truncate"], default="double"), O("--zero-division", choices=["error", "null"], default="error")]),
    "id": ("A row number column", lambda t, a: projection.add_id(t, a.create, a.prefix, a.id_col_name), [O("--create", **FLAG), O("--prefix", default="id"), O("--id-col-name", default="id")]),
    "shuffle": ("Random order", lambda t, a: sampling.shuffle(t, a.random), []),
    "sample": ("Some rows", lambda t, a: sampling.sample(t, a.number, a.method, a.stratify_by, a.random), [O("-n", "--number", type=int, default=10), O("--method", default="random"), O("--stratify-by")]),
    "dedup": ("Without repeats", _dedup, [O("--row-wise", **FLAG), O("--col-wise", **FLAG), O("-c", "--columns"), O("--keep", default="first")]),
    "binning": ("Numeric bins", lambda t, a: binning.bin_columns(t, a.columns, a.bins, a.method, a.labels, a.suffix, a.drop_original, a.include_lowest), [O("-c", "--columns", required=True), O("-b", "--bins", default="10"), O("--method", default="equal-width"), O("--labels"), O("--suffix", default="_binned"), O("--drop-original", **FLAG), O("--include-lowest", **FLAG)]),
    "pivot": ("Aggregates by groups", lambda t, a: summaries.pivot(t, a.index, a.columns, a.values, a.agg, a.fill, a.wide), [O("-i", "--index", required=True), O("-c", "--columns", required=True), O("-l", "--values"), O("-a", "--agg", default="sum"), O("--fill", default="0"), O("--wide", **FLAG)]),
    "merge": ("Join two tables", _merge, [O("-r", "--right", required=True), O("--left-join", **FLAG), O("--right-join", **FLAG), O("--key"), O("--key-mapping")]),
    "append": ("Rows of several tables", _append, [O("--files", required=True), O("--ignore-schema", **FLAG)]),
    "sort": ("Sorted rows", _sort, [O("-c", "--columns", default="all"), O("-s", "--strategy", default="auto"), O("-d", "--descending", nargs="?", const="true", default="false"), O("--nulls", default="last"), O("--date-format"), O("--hour-format"), O("--case-insensitive", **FLAG)]),
    "split": ("Disjoint parts", _split, [O("--ratio", required=True), O("--names"), O("--splits-prefix", default="split"), O("--output-dir", default="."), O("--stratified-by")]),
    "convert": ("Another format", lambda t, a: t, []),
    "optimize": ("Rewrite as Parquet", None, [O("--compression", default="snappy"), O("--compression-level", type=int, default=6), O("--sort-by"), O("--row-group-size", type=int, default=1_000_000), O("--dictionary", **FLAG), O("--no-dictionary", **FLAG), O("--validate", **FLAG)]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridsmith", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    for name, (what, _, options) in COMMANDS.items():
        p = sub.add_parser(name, help=what)
        p.add_argument("input")
        p.add_argument("-o", "--output", required=name == "convert")
        p.add_argument("-f", "--format", choices=["json", "text", "csv", "parquet", "xlsx"])
        p.add_argument("--random", type=int, metavar="SEED")
        p.add_argument("-v", "--verbose", action="store_true")
        p.add_argument("-j", "--jobs", type=int)
        for names, kw in options:
            p.add_argument(*names, **kw)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.INFO if a.verbose else logging.WARNING, format="%(message)s", force=True)
    try:
        spark = session(jobs=a.jobs)
        log.info("Reading %s", a.input)
        if a.command == "optimize":
            path = files.optimize(spark, a.input, a.output, a.compression, a.compression_level, a.sort_by, a.row_group_size, a.dictionary, a.no_dictionary, a.validate, single_file=True)
            log.info("Wrote %s", path)
            return 0
        if a.command == "metadata":
            out = footer.metadata(spark, a.input, tuple(p for p in footer.PARTS if getattr(a, p)), a.all, a.detailed)
        else:
            out = COMMANDS[a.command][1](files.read(spark, a.input), a)
        if out is None:
            return 0
        if a.output:
            files.write(out, a.output, None if a.format == "text" else a.format, single_file=True)
            log.info("Wrote %s", a.output)
        else:
            df: DataFrame = out.df if isinstance(out, Table) else out
            for line in display.lines(df, a.format):
                print(line)
            if a.command == "stats" and not a.format:
                print(f"count | {files.read(spark, a.input).rows.count()}")
        return 0
    except (GridError, NotImplementedError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
    except PySparkException as e:
        print(f"Error: {str(e).splitlines()[0]}", file=sys.stderr)
    return 1


if __name__ == "__main__":
    sys.exit(main())
