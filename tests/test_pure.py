"""Parsers and formulas that need no Spark."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gridsmith import display
from gridsmith.columns import resolve_list, resolve_one
from gridsmith.errors import ColumnNotFound, InvalidArgument, UnsupportedFormat
from gridsmith.functions import special
from gridsmith.functions.expressions import assignments, spark_sql, split_top
from gridsmith.operators.binning import parse_bins
from gridsmith.operators.correlation import p_values
from gridsmith.operators.sampling import ratios, split_names
from gridsmith.operators.sizes import human
from gridsmith.operators.sorting import date_format
from gridsmith.predicates import row_ranges
from gridsmith.sources.files import format_of, json_array, optimize_options


def test_lists_of_columns():
    columns = ["id", "Name", "val_a", "val_b"]
    assert resolve_list(columns, "NAME,id") == ["Name", "id"]
    assert resolve_list(columns, "^val,id,val_a") == ["val_a", "val_b", "id"]
    assert resolve_list(columns, '"id"') == ["id"]
    assert resolve_list(columns, "*") == columns
    assert resolve_list(columns, "") == []
    with pytest.raises(ColumnNotFound, match="Columns not found"):
        resolve_list(columns, "id,zzz,a|b")
    with pytest.raises(InvalidArgument):
        resolve_list(columns, "*(")
    assert resolve_one(columns, '"name"') == "Name"


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(0, 20)), min_size=1, max_size=8))
def test_row_ranges_cover_the_rows_named(parts):
    spec = ",".join(f"{a}-{a + n}" if n else str(a) for a, n in parts)
    want = {r for a, n in parts for r in range(a, a + n + 1)}
    got = row_ranges(spec)
    assert {r for a, b in got for r in range(a, b + 1)} == want
    assert all(b + 1 < c for (_, b), (c, _) in zip(got, got[1:], strict=False))


def test_row_ranges_errors():
    assert row_ranges("0") == [(1, 1)]
    for bad in ("5-3", "x", "1-2-3"):
        with pytest.raises(InvalidArgument):
            row_ranges(bad)


def test_expressions():
    assert split_top("a=f(x,1),b='p,q'") == ["a=f(x,1)", "b='p,q'"]
    assert assignments("a=x>=1, b = c==2") == [("a", "x>=1"), ("b", "c==2")]
    assert spark_sql("\"my col\" + 1 || 'say \"hi\"'") == "`my col` + 1 || 'say \"hi\"'"
    with pytest.raises(InvalidArgument):
        assignments("a>=3")


def test_bins_and_ratios():
    assert parse_bins("5") == 5 and parse_bins("3,1,2") == [1.0, 2.0, 3.0]
    with pytest.raises(InvalidArgument, match="Number of bins must be greater than 0"):
        parse_bins("0")
    assert ratios("0.7,0.3") == [0.7, 0.3] and ratios("70,30") == [0.7, 0.3]
    for bad in ("0.5,0.6", "1.2,-0.2", "x"):
        with pytest.raises(InvalidArgument):
            ratios(bad)
    assert split_names(2, "a,b.csv", extension="json") == ["a.json", "b.csv"]
    assert split_names(2, prefix="p") == ["p_1.parquet", "p_2.parquet"]


def test_distributions():
    assert math.isclose(special.normal_two_sided(1.959964), 0.05, abs_tol=1e-6)
    assert math.isclose(special.student_two_sided(2.228139, 10), 0.05, abs_tol=1e-6)
    assert math.isclose(special.student_two_sided(12.7062, 1), 0.05, abs_tol=1e-5)
    assert math.isclose(special.chi2_one(3.841459), 0.05, abs_tol=1e-6)
    assert special.incomplete_beta(2, 3, 0) == 0 and special.incomplete_beta(2, 3, 1) == 1
    assert p_values(0.5, 3) == (None, None, None) and p_values(1.0, 9) == (0.0, 0.0, 0.0)


def test_formats_and_sizes():
    assert format_of("/a/b.parquet") == "parquet"
    with pytest.raises(UnsupportedFormat):
        format_of("x.txt")
    assert human(512) == "512 B" and human(2048) == "2.00 KB" and human(2, bits=True) == "16 bits"
    assert date_format("dd/mm/yyyy") == "dd/MM/yyyy"
    with pytest.raises(InvalidArgument, match="Compression level must be between 1 and 9"):
        optimize_options("zstd", 10)
    assert json_array([{"a": float("inf"), "b": 'q"'}]) == '[\n  {\n    "a": null,\n    "b": "q\\""\n  }\n]'
    assert display.number(0.0001) == "1.00e-04" and display.number(2.5) == "2.500"
    assert "Record 1" in display.cards([{"a": 1}])
    assert "1.000" in display.matrix([{"variable": "x", "corr_with_x": 1.0}])


def test_divisions_are_found():
    from gridsmith.functions.expressions import with_divisions

    d = lambda a, b: f"D[{a}|{b}]"
    for text, want in [
        ("a/b", "D[a|b]"),
        ("a / b / c", "D[D[a|b]|c]"),
        ("a*b/c+d", "D[a * b|c] + d"),
        ("-a / -b", "- D[a|-b]"),
        ("f(x/2, 'a/b') / (c/d)", "D[f(D[x|2] , 'a/b')|(D[c|d])]"),
        ("CASE WHEN a/2 > 1 THEN b ELSE c/3 END / 4", "D[CASE when D[a|2] > 1 then b else D[c|3] END|4]"),
        ("`x/y` / 2 AND p OR q / 3", "D[`x/y`|2] AND p OR D[q|3]"),
        ("m[1/1]/2::int", "D[m[D[1|1]]|2::int]"),
    ]:
        assert with_divisions(text, d).lower() == want.lower()
