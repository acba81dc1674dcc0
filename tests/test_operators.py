"""Operators on small tables: pinned results, nulls, errors and invariants."""

import pytest
from pyspark.sql import functions as F

from gridsmith.errors import ColumnNotFound, InvalidArgument, SchemaMismatch, StatisticsError
from gridsmith.frame import Table
from gridsmith.plans.rowid import RID
from gridsmith.operators import binning, correlation, dedup, filling, filtering, joining, outliers, projection, sampling, sizes, sorting, summaries


def rows(t):
    """Tuples; of a table, in its order."""
    if isinstance(t, Table):
        t = t.settled().rows.orderBy(RID).drop(RID)
    return [tuple(r) for r in t.collect()]


def ids(t):
    return [r[t.columns.index("id")] for r in rows(t)]


def test_rows_by_number(tables):
    t = tables["sample"]
    assert ids(filtering.head(t, 2)) == [1, 2] and ids(filtering.tail(t, 2)) == [4, 5]
    assert sorted(ids(filtering.tail(t, 9))) == [1, 2, 3, 4, 5]
    assert sorted(ids(filtering.select_rows(t, "1,3-4,99"))) == [1, 3, 4]
    assert sorted(ids(filtering.drop_rows(t, "2,5"))) == [1, 3, 4]
    assert ids(filtering.page(t, 1, 2)) == [3, 4]
    # numbers count the rows that are left
    assert ids(filtering.select_rows(filtering.filter_where(t, "category=q"), "2")) == [4]


def test_conditions(tables):
    t = tables["sample"]
    assert ids(filtering.filter_where(t, "id>3,category=q")) == [4]
    assert ids(filtering.filter_where(t, "NAME!=Nat,value<=310")) == [1, 3]
    assert ids(filtering.drop_rows(t, "value>=300")) == [1, 2]
    assert rows(filtering.filter_where(tables["mixed"], "bool_col=true").select("int_col")) == [(7,), (9,)]
    for bad in ("id>x", "id", "bool_col=1"):
        with pytest.raises(InvalidArgument):
            filtering.filter_where(tables["mixed"] if "bool" in bad else t, bad)
    with pytest.raises(ColumnNotFound):
        filtering.filter_where(t, "nope=1")


def test_row_filters(tables):
    t = tables["mixed"]
    assert filtering.filter_rows(t, "no-nan").df.count() == 2
    assert filtering.filter_rows(t, "numeric-only").df.count() == 2
    assert filtering.filter_rows(t, "char-only").df.count() == 3
    assert filtering.filter_rows(t, "no-zeros").df.count() == 1
    with pytest.raises(InvalidArgument):
        filtering.filter_rows(t, "odd")


def test_search(tables):
    t = tables["sample"]
    assert ids(filtering.search(t, "LI", ignore_case=True)) == [1, 3]
    assert ids(filtering.search(t, "310", exact=True)) == [3]
    assert filtering.search(t, "%").df.count() == 0
    assert rows(filtering.search_positions(t, "75", "value")) == [(2, "75", "value"), (4, "75", "value"), (5, "75", "value")]
    with pytest.raises(InvalidArgument):
        filtering.search(tables["mixed"], "x", "bool_col")


def test_columns(tables):
    t = tables["sample"]
    assert projection.select_columns(t, "^na,id").columns == ["name", "id"]
    assert projection.drop_columns(t, "id,name").columns == ["value", "category"]
    assert projection.rename(t, "id=name,name=id").columns == ["name", "id", "value", "category"]
    with pytest.raises(InvalidArgument, match="already exists"):
        projection.rename(t, "id=name")
    with pytest.raises(ColumnNotFound):
        projection.rename(t, "zz=a")
    made = projection.create(t, "double=value*2,label=concat(name, ',', category)", "id > 3")
    assert rows(made.select("double", "label")) == [(951.0, "Oto,q"), (1500.0, "Pia,r")]
    with pytest.raises(InvalidArgument, match="already exists"):
        projection.create(t, "id=1")
    with pytest.raises(InvalidArgument):
        projection.create(t, "x=nope+1")
    assert rows(projection.add_id(t, prefix="r", name="k").select("k"))[0] == ("r1",)
    assert projection.add_id(t, create=False) is t
    assert [r[0] for r in rows(projection.headers(t, "a"))] == ["name", "value", "category"]
    assert rows(projection.schema(t))[0] == ("id", "Int64", True)


def test_joins(tables):
    a, b = tables["sample"], tables["sample2"]
    assert joining.merge(a, b, key_mapping="id=user_id").df.count() == 2
    assert joining.merge(a, b, key_mapping="id=user_id", how="left").df.count() == 5
    right = joining.merge(a, b, key_mapping="id=user_id", how="right")
    assert right.df.count() == 4 and right.columns == ["id", "name", "value", "category", "r_score"]
    assert sorted(r["id"] or 0 for r in right.df.collect()) == [0, 0, 4, 5]
    kept = joining.merge(a, b, key_mapping="id=user_id", how="right", coalesce_key=True)
    assert sorted(r["id"] for r in kept.df.collect()) == [4, 5, 6, 7]
    assert ids(filtering.head(joining.merge(a, b, key_mapping="id=user_id", how="left"), 3)) == [1, 2, 3]
    assert joining.merge(a, a, key="ID").columns == ["id", "name", "value", "category", "r_name", "r_value", "r_category"]
    with pytest.raises(InvalidArgument, match="must be specified"):
        joining.merge(a, b)


def test_unions(tables):
    a, b = tables["sample"], tables["sample2"]
    assert joining.append([a, a]).df.count() == 10
    with pytest.raises(SchemaMismatch, match="Schema mismatch"):
        joining.append([a, b])
    mixed = joining.append([a, projection.rename(b, "user_id=ID")], ignore_schema=True)
    assert mixed.columns == a.columns and ids(filtering.tail(mixed, 2)) == [6, 7]
    assert mixed.df.where("value IS NULL").count() == 4


def test_dedup(tables):
    t = tables["repeats"]
    assert dedup.dedup_rows(t, "id,name").df.count() == 4
    assert dedup.dedup_rows(t, keep="last").df.count() == 5
    assert sorted(rows(dedup.dedup_rows(t, "id", "last"))) == [(1, "ab", 7), (2, "cd", 9), (3, "ef", 5), (4, "gh", 6)]
    assert sorted(rows(dedup.dedup_rows(tables["nulls"], "name")))[0] == (1, "k", 10.0)
    assert dedup.dedup_rows(tables["nulls"], "name").df.count() == 4
    once = dedup.dedup_rows(t, "id")
    assert sorted(rows(dedup.dedup_rows(once, "id"))) == sorted(rows(once))
    assert dedup.dedup_rows(t, "") is t
    doubled = projection.create(t, "id2=id,val2=val+0,name2=name,other=val+1")
    assert dedup.dedup_columns(doubled).columns == ["id", "name", "val", "other"]
    assert dedup.dedup_columns(doubled, keep="last").columns == ["id2", "val2", "name2", "other"]
    with pytest.raises(InvalidArgument):
        dedup.dedup_rows(t, "id", "middle")


def test_sorting(tables):
    t = tables["nulls"]
    assert ids(sorting.sort(t, "value", descending=True)) == [4, 2, 1, 3, 5]
    assert ids(sorting.sort(t, "value", nulls="first")) == [3, 5, 1, 2, 4]
    assert ids(sorting.sort(t, "name,value", descending=[True, False], nulls="skip")) == [1]
    assert ids(filtering.select_rows(sorting.sort(t, "value", descending=True), "2-3")) == [2, 1]
    assert ids(projection.select_columns(filtering.head(sorting.sort(tables["sample"], "name", descending=True), 2), "id")) == [5, 4]
    dates = projection.create(tables["sample"], "d=concat('0', id, '/0', 6-id, '/2020')")
    assert ids(sorting.sort(dates, "d", "date", date_fmt="dd/mm/yyyy")) == [5, 4, 3, 2, 1]
    hours = projection.create(tables["sample"], "h=concat('0', 6-id, ':00:00')")
    assert ids(sorting.sort(hours, "h", "hour", hour_fmt="hh:mm:ss")) == [5, 4, 3, 2, 1]
    for bad in ({"strategy": ["auto"] * 3}, {"nulls": "x"}, {"strategy": "odd"}):
        with pytest.raises(InvalidArgument):
            sorting.sort(t, "id,name", **bad)


def test_counts_and_pivots(tables):
    t = tables["sample"]
    assert rows(summaries.count_rows(tables["empty"])) == [(0,)]
    assert rows(summaries.frequency(t, "category", percentage=True)) == [("p", 2, 40.0), ("q", 2, 40.0), ("r", 1, 20.0)]
    assert rows(summaries.frequency(tables["nulls"], "name"))[0] == (None, 2)
    assert sorted(rows(summaries.pivot(t, "category", "name", agg="count", values="value")))[0] == ("p", "Lio", 1)
    wide = summaries.pivot(t, "id", "category", "value", wide=True, fill=0)
    assert wide.columns == ["id", "p", "q", "r"] and wide.where("p = 0").count() == 3
    with pytest.raises(InvalidArgument, match="is not numeric"):
        summaries.pivot(t, "id", "category", "name")


def test_stats(tables):
    out = {r["column_name"]: r for r in summaries.stats(tables["nulls"]).collect()}
    assert out["value"]["count"] == 3 and out["value"]["q50"] == 30.0 and out["name"]["mean"] is None and out["name"]["num_classes"] == 3
    deep = {r["column_name"]: r for r in summaries.stats(tables["repeats"], kind="exhaustive").collect()}
    assert deep["val"]["duplicates"] == 2 and deep["name"]["num_classes"] == 4
    assert rows(summaries.stats(tables["empty"], "id")) == [("id", 0, None, None, None, None, 0)]
    with pytest.raises(NotImplementedError):
        summaries.stats(tables["sample"], kind="hypothesis")
    near = summaries.stats(tables["bins"], "score", accuracy=1000, approximate_distinct=True).first()
    assert near["num_classes"] == 10 and near["q25"] <= near["q50"] <= near["q75"]


def test_quantiles_and_counts_against_all_values(spark, monkeypatch):
    import numpy as np

    from gridsmith.plans import quantiles

    monkeypatch.setattr(quantiles, "RANGES", 5)
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 500), rng.normal(size=500).round(2)
    rows_ = [(int(x) + 2**60 if x < 8 else None, float(y) if y < 1.5 else None, None) for x, y in zip(a, b, strict=True)]
    df = spark.createDataFrame(rows_, "a long, b double, c double").repartition(3)
    ps = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = quantiles.row_of(df, [F.col("a") - 2**60, F.col("b"), F.col("c")], ps).first()
    for i, c in ((0, [r[0] - 2**60 for r in rows_ if r[0] is not None]), (1, [r[1] for r in rows_ if r[1] is not None])):
        assert np.allclose(got[f"q{i}"], np.quantile(c, ps))
    assert got["q2"] is None
    out = {r["column_name"]: r["num_classes"] for r in summaries.stats(Table.of(df)).collect()}
    assert out == {"a": 8, "b": len({r[1] for r in rows_} - {None}), "c": 0}


def test_numbers_after_a_sort_with_few_first_keys(spark):
    t = Table.of(spark.range(3000).select("id", (F.col("id") % 2).alias("k"), F.lit("same").alias("s")).repartition(6), ["id"])
    out = sorting.sort(t, "s,k,id", descending=[False, True, False]).settled().rows.orderBy(RID)
    assert [r["id"] for r in out.collect()] == [*range(1, 3000, 2), *range(0, 3000, 2)] and out.agg(F.max(RID)).first()[0] == 3000


def test_correlations(tables, spark):
    t = tables["bins"]
    assert rows(correlation.correlations(t, "score,age"))[0][2] > 0.99
    assert rows(correlation.correlations(t, "score,age", "spearman")) == [("score", "age", 1.0)]
    assert rows(correlation.correlations(t, "score,age", "kendall")) == [("score", "age", 1.0)]
    m = correlation.matrix(t, "score,age,id")
    assert [r["variable"] for r in m.collect()] == ["age", "id", "score"] and m.first()["corr_with_age"] == 1.0
    tests = correlation.correlations(t, "score,age", tests=True).first()
    assert tests["p_t"] < 1e-6 and tests["p_fisher"] < 1e-6
    with pytest.raises(StatisticsError, match="numeric columns only"):
        correlation.correlations(t, "score,grade")
    with pytest.raises(StatisticsError):
        correlation.correlations(tables["nulls"], "value")
    # nulls are left out pair by pair
    odd = Table.of(spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (None, 9.0), (4.0, None), (5.0, 2.0)], "a double, b double"))
    assert rows(correlation.correlations(odd, "a,b", "spearman")) == [("a", "b", 0.5)]
    assert rows(correlation.correlations(odd, "a,b", "kendall")) == [("a", "b", 0.3333)]


def test_kendall_beyond_the_broadcast(tables, spark, monkeypatch):
    df = spark.range(200).select((F.col("id") % 37).cast("double").alias("a"), ((F.col("id") * 7) % 23).cast("double").alias("b"))
    want = correlation.kendall(df, "a", "b").first()[0]
    monkeypatch.setattr(correlation, "KENDALL_ROWS", 0)
    assert abs(correlation.kendall(df, "a", "b").first()[0] - want) < 1e-12


def test_outliers(spark):
    t = Table.of(spark.createDataFrame([(i, float(v)) for i, v in enumerate([*range(1, 11), 90, 170])] + [(99, None)], "id long, value double").coalesce(1))
    assert sorted(r["value"] for r in outliers.detect(t, "value", show_values=True).collect()) == [90.0, 170.0]
    assert sorted(rows(outliers.detect(t, "value", row_numbers=True).select("row_number"))) == [(11,), (12,)]
    assert outliers.detect(t, "value", "z-score", threshold=2.0).count() == 1
    assert outliers.detect(t, "value", "modified-z-score").count() == 2
    assert outliers.remove(t, "value").df.count() == 10
    flat = Table.of(spark.createDataFrame([(1.0,), (1.0,)], "x double"))
    assert outliers.detect(flat, "x", "z-score").count() == 0 and outliers.remove(flat, "x", "z-score").df.count() == 2
    with pytest.raises(StatisticsError):
        outliers.detect(t, "value", "odd")


def test_filling(tables, spark):
    t = tables["nulls"]
    assert filling.fill(t, "value", "0").df.where("value IS NULL OR name IS NULL").count() == 0
    assert rows(filling.fill(t, "mean").select("value"))[2] == (40.0,)
    assert rows(filling.fill(t, "median").select("value"))[2] == (30.0,)
    assert rows(filling.fill(tables["repeats"], "mode"))[0] == (1, "ab", 7)
    assert rows(filling.fill(t, "mode", columns="name").select("name"))[1] == ("k",)
    assert rows(filling.fill_direction(t, "forward", block=2).select("name", "value")) == [("k", 10.0), ("k", 30.0), ("m", 30.0), ("m", 80.0), ("w", 80.0)]
    assert rows(filling.fill_direction(t, "backward", block=2).select("name", "value")) == [("k", 10.0), ("m", 30.0), ("m", 80.0), ("w", 80.0), ("w", None)]
    for bad in ({"method": "value"}, {"method": "value", "value": "x", "columns": "id"}, {"method": "mean", "columns": "name"}, {"method": "odd"}):
        with pytest.raises(InvalidArgument):
            filling.fill(t, **bad)


def test_binning(tables):
    t = tables["bins"]
    out = binning.bin_columns(t, "score", 3, labels="low,mid,high")
    assert [r[-1] for r in rows(out)] == ["low"] * 3 + ["mid"] * 4 + ["high"] * 3
    assert binning.bin_columns(t, "score", "0,50,80", "custom").df.where("score_binned = 'NULL'").count() == 3
    assert binning.bin_columns(t, "score", "0,50,80", "custom", other_label=None).df.where("score_binned IS NULL").count() == 3
    assert binning.bin_columns(t, "age", 2, "equal-frequency").df.groupBy("age_binned").count().count() == 2
    assert binning.bin_columns(t, "score,age", 2, drop_original=True).columns == ["id", "grade", "score_binned", "age_binned"]
    with pytest.raises(InvalidArgument, match=r"Number of labels \(2\) must match number of bins \(3\)"):
        binning.bin_columns(t, "score", 3, labels="a,b")
    with pytest.raises(InvalidArgument, match="must be numeric"):
        binning.bin_columns(t, "grade", 3)
    assert binning.bin_columns(filtering.filter_where(t, "id<0"), "score", 3).df.count() == 0


def test_samples(tables):
    t = tables["strata"]
    assert sampling.sample(t, 7, seed=1).df.count() == 7 and sampling.sample(t, 99).df.count() == 20
    assert sorted(ids(sampling.sample(t, 7, seed=1))) == sorted(ids(sampling.sample(t, 7, seed=1)))
    assert sorted(ids(sampling.shuffle(t, 3))) == list(range(20))
    assert ids(sampling.shuffle(t, 3)) != list(range(20))
    got = sampling.sample(t, 8, "stratified", "strat_key", 5).df.groupBy("strat_key").count().collect()
    assert {r[0]: r[1] for r in got} == {"w": 4, "x": 2, "y": 1, "z": 1}
    assert ids(sampling.preview(t, 5, 2)) == sorted(ids(sampling.preview(t, 5, 2)))
    with pytest.raises(InvalidArgument):
        sampling.sample(t, 3, "stratified")


def test_splits(tables):
    a, b = sampling.split(tables["sample"], "0.6,0.4", seed=4)
    assert a.df.count() == 3 and b.df.count() == 2 and sorted(ids(a) + ids(b)) == [1, 2, 3, 4, 5]
    a, b = sampling.split(tables["strata"], "0.5,0.5", "strat_key", seed=4)
    assert 9 <= a.df.count() <= 11 and sorted(ids(a) + ids(b)) == list(range(20))
    assert {r[0]: r[1] for r in a.df.groupBy("strat_key").count().collect()}["w"] == 5


def test_sizes(tables):
    out = dict(rows(sizes.size(tables["sample"], per_column=True, per_row=True)))
    assert out["total_rows"] == "5" and out["column_id"] == "40 B" and out["memory_size"] == "320 B"


def test_plans_read_once_and_shuffle_nothing(tables, spark, tmp_path):
    path = str(tmp_path / "x.parquet")
    spark.range(1000).select("id", (F.col("id") * 1.5).alias("v"), F.col("id").cast("string").alias("s")).coalesce(1).write.parquet(path)
    from gridsmith.sources import files

    t = files.read(spark, path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    local = filtering.filter_where(projection.select_columns(t, "id"), "id>5").df
    assert "Exchange" not in plan(local) and "PushedFilters: [IsNotNull(id), GreaterThan(id,5)]" in plan(local)
    out = summaries.stats(t, "id,v,s")
    out.collect()
    ran = plan(out).split("Initial Plan")[0]
    assert ran.count("FileScan") - ran.count("ReusedExchange") <= 2  # the moments, and one count of all values
    assert plan(correlation.correlations(t, "id,v")).count("FileScan") == 1
