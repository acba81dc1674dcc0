"""Files, footers, the command line, streams and row identity."""

import json

import pytest
from pyspark.sql import functions as F

from gridsmith import cli, streaming
from gridsmith.errors import FileError, InvalidArgument, UnsupportedFormat
from gridsmith.frame import Table
from gridsmith.operators import filtering, projection
from gridsmith.plans.rowid import RID
from gridsmith.sources import files, footer, xlsx


@pytest.mark.parametrize("ext", ["parquet", "csv", "json", "xlsx"])
def test_round_trips(spark, tables, tmp_path, ext):
    path = str(tmp_path / f"out.{ext}")
    files.write(tables["sample"], path)
    back = files.read(spark, path)
    assert [tuple(r) for r in back.rows.orderBy(RID).select("id", "name", "value", "category").collect()] == [tuple(r) for r in tables["sample"].df.collect()]
    assert sorted(r[RID] for r in back.rows.collect()) == [1, 2, 3, 4, 5]


def test_empty_tables_keep_their_columns(spark, tables, tmp_path):
    for ext in ("parquet", "csv"):
        path = str(tmp_path / f"empty.{ext}")
        files.write(tables["empty"], path)
        assert files.read(spark, path).columns == ["id", "data"]


def test_nulls_are_written_to_json(tables, tmp_path):
    path = tmp_path / "n.json"
    files.write(tables["nulls"], str(path), single_file=True)
    assert [json.loads(x) for x in path.read_text().splitlines()][1] == {"id": 2, "name": None, "value": 30.0}


def test_xlsx_types(spark, tmp_path):
    import datetime as dt

    path = str(tmp_path / "t.xlsx")
    xlsx.write(["a", "b", "c", "d"], [(1, 1.5, "x<&", True), (2, 2.5, None, dt.date(2020, 1, 1))], path)
    df = xlsx.read(spark, path)
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "string"}
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, "x<&", "True"), (2, 2.5, None, "43831")]
    with pytest.raises(FileError):
        xlsx.read(spark, str(tmp_path / "none.xlsx"))


def test_rows_of_a_folder_are_numbered_across_files(spark, tmp_path):
    path = str(tmp_path / "many.parquet")
    spark.range(100).repartition(4).write.parquet(path)
    got = files.read(spark, path).rows.orderBy(RID)
    assert [r[RID] for r in got.collect()] == list(range(1, 101))
    order = got.select("id", RID, F.lit(0)).collect()
    assert order == files.read(spark, path).rows.orderBy(RID).select("id", RID, F.lit(0)).collect()


def test_optimize_and_footer(spark, tables, tmp_path):
    a, b = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    files.write(tables["nulls"], a)
    files.optimize(spark, a, b, "zstd", 3, sort_by="value", no_dictionary=True, validate=True, single_file=True)
    assert [r["id"] for r in files.read(spark, b).df.collect()] == [3, 5, 1, 2, 4]
    out = dict((r["key"], r["value"]) for r in footer.metadata(spark, b, every=True, detailed=True).collect())
    assert out["total_rows"] == "5" and out["rg_0_col_0_compression"] == "ZSTD" and "compression_ZSTD_ratio" in out
    assert footer.count(spark, b) == 5
    big = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("s"))
    sizes = []
    for level in (1, 9):
        files.write(big, str(tmp_path / f"g{level}.parquet"), "parquet", True, files.optimize_options("gzip", level))
        sizes.append((tmp_path / f"g{level}.parquet").stat().st_size)
    assert sizes[0] > sizes[1]
    with pytest.raises(InvalidArgument, match="Cannot specify both"):
        files.optimize(spark, a, b, dictionary=True, no_dictionary=True)
    with pytest.raises(UnsupportedFormat):
        footer.metadata(spark, "x.csv")
    with pytest.raises(FileError):
        files.read(spark, str(tmp_path / "none.parquet"))


def test_command_line(spark, tables, tmp_path, capsys):
    path = str(tmp_path / "s.parquet")
    files.write(tables["sample"], path, single_file=True)
    run = lambda *a: (cli.main(list(a)), capsys.readouterr())
    code, out = run("head", path, "-n", "2", "-f", "json")
    assert code == 0 and [r["id"] for r in json.loads(out.out)] == [1, 2]
    code, out = run("filter", path, "-c", "id>3,category=q", "-f", "json")
    assert code == 0 and len(json.loads(out.out)) == 1
    code, out = run("stats", path)
    assert code == 0 and out.out.endswith("count | 5\n")
    code, out = run("frequency", path, "-c", "category")
    assert code == 0 and "percentage" in out.out and "40.000" in out.out
    assert run("correlations", path, "--matrix", "-c", "id,value")[0] == 0
    target = str(tmp_path / "o.csv")
    assert run("sort", path, "-c", "value", "-d", "-o", target)[0] == 0 and files.read(spark, target).df.first()["id"] == 5
    assert run("split", path, "--ratio", "0.6,0.4", "--random", "1", "--output-dir", str(tmp_path))[0] == 0
    assert files.read(spark, str(tmp_path / "split_1.parquet")).df.count() == 3
    for bad, words in ((["dedup", path], "Must specify either --row-wise or --col-wise"), (["select", path, "-c", "zz"], "Columns not found"), (["split", path, "--ratio", "0.5,0.6"], "must sum to 1.0 or 100.0"), (["head", "x.txt"], "Unsupported"), (["metadata", target], "Unsupported"), (["head", path, "-f", "csv"], "needs an output file")):
        code, out = run(*bad)
        assert code == 1 and words in out.err and not out.out
    for name in ("tail", "preview", "headers", "schema", "count", "size", "metadata", "shuffle", "sample"):
        assert run(name, path)[0] == 0


def test_console_has_all_rows(spark, tmp_path, capsys):
    path = str(tmp_path / "many")
    spark.range(0, 10_500, 1, 3).write.parquet(f"{path}.parquet")
    assert cli.main(["filter", f"{path}.parquet", "-c", "id>=0", "-f", "json"]) == 0
    assert sorted(r["id"] for r in json.loads(capsys.readouterr().out)) == list(range(10_500))
    assert cli.main(["filter", f"{path}.parquet", "-c", "id>=0"]) == 0
    out = capsys.readouterr().out
    assert " Record 10500 " in out and out.endswith("Total records: 10500\n")


def test_streams(spark, tmp_path):
    path = str(tmp_path / "ev" / "events.parquet")
    spark.sql("SELECT id, timestamp_ntz '2020-01-01 00:00:00' + make_interval(0,0,0,0,id) AS ts, cast(id % 2 AS string) AS kind FROM range(48)").write.parquet(path)
    s = streaming.read(spark, str(tmp_path / "ev"), "events")
    got = streaming.run_to_table(streaming.pipeline(s, "id>=40", "twice=id*2", "id,twice"))
    assert sorted(tuple(r) for r in got.collect()) == [(i, 2 * i) for i in range(40, 48)]
    counts = streaming.run_to_table(streaming.frequency(s, "ts", "kind", "1 day", "1 day"), "complete")
    assert sorted(r["frequency"] for r in counts.collect()) == [12, 12, 12, 12]


def test_tables_of_frames(spark):
    t = Table.of(spark.range(10).repartition(3), order_by=["id"])
    assert [r["id"] for r in filtering.select_rows(t, "3-4").df.orderBy("id").collect()] == [2, 3]
    assert projection.add_id(t, prefix="", name="n").df.where("n = id + 1").count() == 10


def test_registered_queries_have_names_and_oracles():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
