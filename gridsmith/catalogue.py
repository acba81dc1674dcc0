"""Registered queries of the tabular operators and their DuckDB twins.

Every query reads whole tables.  In the SQL, ``rn`` is the row number in file
order.  Floating sums are rounded on both sides, since their order may differ.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith import streaming
from gridsmith.frame import Table, quoted
from gridsmith.operators import binning, correlation, dedup, filling, filtering, joining, outliers, projection, sampling, sizes, sorting, summaries
from gridsmith.plans import store
from gridsmith.sources import files, footer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SEED = 42


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return files.read(spark, f"{sf_dir}/{name}.parquet")


def simple(name: str, table: str, f: Callable[[Table], Table | DataFrame], sql: str | None = None) -> None:
    def run(spark, sf_dir):
        out = f(load(spark, sf_dir, table))
        return out.df if isinstance(out, Table) else out

    query(name, sql)(run)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(quoted(f.name), digits).alias(f.name) if f.dataType.simpleString() == "double" else quoted(f.name) for f in df.schema])


def numbered(table: str) -> str:
    return f"(SELECT *, row_number() OVER () AS rn FROM {table})"


HASHED = f"md5(rn::VARCHAR || '{SEED}')"


# The flagship: filter, aggregate, sort.
@query("flagship", "SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 4) AS o_totalprice_mean FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY ALL")
def flagship(spark, sf_dir):
    t = filtering.filter_where(load(spark, sf_dir, "orders"), "o_orderstatus=F,o_totalprice>1000")
    out = summaries.pivot(t, "o_orderpriority", "o_orderstatus", "o_totalprice", "mean")
    return rounded(out).orderBy(F.col("o_totalprice_mean").desc())


# Rows and columns
simple("head", "orders", lambda t: filtering.head(t, 10), f"SELECT * EXCLUDE rn FROM {numbered('orders')} WHERE rn <= 10")
simple("tail", "orders", lambda t: filtering.tail(t, 10), f"SELECT * EXCLUDE rn FROM {numbered('orders')} WHERE rn > (SELECT count(*) - 10 FROM orders)")
simple("page", "orders", lambda t: filtering.page(t, 2, 100), f"SELECT * EXCLUDE rn FROM {numbered('orders')} WHERE rn BETWEEN 201 AND 300")
simple("count_rows", "lineitem", summaries.count_rows, "SELECT count(*) AS row_count FROM lineitem")
simple("select_cols", "lineitem", lambda t: projection.select_columns(t, "L_ORDERKEY,l_quantity"), "SELECT l_orderkey, l_quantity FROM lineitem")
simple("select_regex", "lineitem", lambda t: projection.select_columns(t, "l_orderkey,^l_ext,key$"), "SELECT l_orderkey, l_extendedprice, l_partkey, l_suppkey FROM lineitem")
simple("select_rows", "lineitem", lambda t: filtering.select_rows(t, "1,3,5-10"), f"SELECT * EXCLUDE rn FROM {numbered('lineitem')} WHERE rn IN (1, 3) OR rn BETWEEN 5 AND 10")
simple("drop_cols", "lineitem", lambda t: projection.drop_columns(t, "l_shipdate,^l_line"), "SELECT * EXCLUDE (l_shipdate, l_linenumber, l_linestatus) FROM lineitem")
simple("drop_rows", "lineitem", lambda t: filtering.drop_rows(t, "2,4-6"), f"SELECT * EXCLUDE rn FROM {numbered('lineitem')} WHERE rn <> 2 AND rn NOT BETWEEN 4 AND 6")
simple("drop_where", "lineitem", lambda t: filtering.drop_rows(t, "l_quantity>=25,l_discount<0.05"), "SELECT * FROM lineitem WHERE NOT (l_quantity >= 25 AND l_discount < 0.05)")
simple("select_after_filter", "orders", lambda t: filtering.select_rows(filtering.filter_where(t, "o_orderstatus=F"), "2-40"), f"SELECT * EXCLUDE (rn, k) FROM (SELECT *, row_number() OVER (ORDER BY rn) AS k FROM {numbered('orders')} WHERE o_orderstatus = 'F') WHERE k BETWEEN 2 AND 40")

# Filters
simple("filter_and", "lineitem", lambda t: filtering.filter_where(t, "l_quantity>=25,l_discount<0.05"), "SELECT * FROM lineitem WHERE l_quantity >= 25 AND l_discount < 0.05")
simple("filter_ne", "orders", lambda t: filtering.filter_where(t, "o_orderstatus!=O,o_totalprice<=20000"), "SELECT * FROM orders WHERE o_orderstatus <> 'O' AND o_totalprice <= 20000")
simple("filter_str", "customer", lambda t: filtering.filter_where(t, "c_mktsegment=BUILDING"), "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
simple("filter_date", "orders", lambda t: filtering.filter_where(t, "o_orderdate>=1995-06-01"), "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01'")
NULLED = "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS l_discount, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS l_returnflag, CASE WHEN l_linenumber = 2 THEN '' ELSE l_linestatus END AS l_linestatus, l_tax FROM lineitem"


def with_nulls(t: Table) -> Table:
    three = F.col("l_linenumber") == 3
    return t.select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), F.when(~three, F.col("l_returnflag")).alias("l_returnflag"), F.when(F.col("l_linenumber") == 2, F.lit("")).otherwise(F.col("l_linestatus")).alias("l_linestatus"), "l_tax")


simple("filter_no_nan", "lineitem", lambda t: filtering.filter_rows(with_nulls(t), "no-nan"), f"SELECT * FROM ({NULLED}) WHERE l_discount IS NOT NULL AND l_returnflag IS NOT NULL")
simple("filter_numeric_only", "lineitem", lambda t: filtering.filter_rows(with_nulls(t), "numeric-only"), f"SELECT * FROM ({NULLED}) WHERE l_discount IS NOT NULL")
simple("filter_char_only", "lineitem", lambda t: filtering.filter_rows(with_nulls(t), "char-only"), f"SELECT * FROM ({NULLED}) WHERE l_returnflag <> '' AND l_linestatus <> ''")
simple("filter_no_zeros", "lineitem", lambda t: filtering.filter_rows(with_nulls(t), "no-zeros"), f"SELECT * FROM ({NULLED}) WHERE l_orderkey <> 0 AND l_linenumber <> 0 AND l_discount <> 0 AND l_tax <> 0")
simple("search_ci", "part", lambda t: filtering.search(t, "Small", "p_name,p_type", ignore_case=True), "SELECT * FROM part WHERE lower(p_name) LIKE '%small%' OR lower(p_type) LIKE '%small%'")
simple("search_exact", "part", lambda t: filtering.search(t, "Brand#23", "p_brand", exact=True), "SELECT * FROM part WHERE p_brand = 'Brand#23'")
simple("search_num", "orders", lambda t: filtering.search(t, "77", "o_orderkey,o_custkey"), "SELECT * FROM orders WHERE o_orderkey::VARCHAR LIKE '%77%' OR o_custkey::VARCHAR LIKE '%77%'")
simple("search_rows", "orders", lambda t: filtering.search_positions(t, "77", "o_orderkey"), f"SELECT rn AS row_number, '77' AS search_value, 'o_orderkey' AS matched_columns FROM {numbered('orders')} WHERE o_orderkey::VARCHAR LIKE '%77%'")
simple("search_long_text", "pages", lambda t: filtering.search(t, "cheap-pills", ignore_case=True), "SELECT * FROM pages WHERE lower(url) LIKE '%cheap-pills%' OR lower(html) LIKE '%cheap-pills%'")

# Columns
simple("rename_swap", "nation", lambda t: projection.rename(t, "n_name=n_nationkey,n_nationkey=n_name"), "SELECT n_nationkey AS n_name, n_name AS n_nationkey, n_regionkey FROM nation")
simple("create_arith", "lineitem", lambda t: rounded(projection.create(t, "revenue=l_extendedprice*(1-l_discount),twice=l_quantity*2").df), "SELECT * REPLACE (round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice, round(l_discount, 4) AS l_discount, round(l_tax, 4) AS l_tax), round(l_extendedprice * (1 - l_discount), 4) AS revenue, round(l_quantity * 2, 4) AS twice FROM lineitem")
simple("create_case", "orders", lambda t: projection.create(t, "size_class=CASE WHEN o_totalprice >= 200000 THEN 'big' ELSE 'small' END, code=concat(substr(\"o_orderpriority\", 1, 1), o_orderstatus)"), "SELECT *, CASE WHEN o_totalprice >= 200000 THEN 'big' ELSE 'small' END AS size_class, substr(o_orderpriority, 1, 1) || o_orderstatus AS code FROM orders")
simple("create_filtered", "orders", lambda t: projection.create(t, "k=o_custkey+1", "o_totalprice > 100000 AND o_orderstatus IN ('F', 'P')"), "SELECT *, o_custkey + 1 AS k FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IN ('F', 'P')")
simple("create_division", "lineitem", lambda t: projection.select_columns(projection.create(t, "half=l_linenumber/2,rate=l_extendedprice/l_quantity,safe=2*l_quantity/(l_linenumber-1),whole=l_orderkey/(l_linenumber-1)", int_division="truncate", zero_division="null"), "l_orderkey,l_linenumber,half,rate,safe,whole"), "SELECT l_orderkey, l_linenumber, (l_linenumber // 2)::BIGINT AS half, l_extendedprice / l_quantity AS rate, CASE WHEN l_linenumber <> 1 THEN 2 * l_quantity / (l_linenumber - 1) END AS safe, CASE WHEN l_linenumber <> 1 THEN l_orderkey // (l_linenumber - 1) END AS whole FROM lineitem")
simple("id_prefix", "nation", lambda t: projection.add_id(t, prefix="REC-", name="id"), f"SELECT 'REC-' || rn AS id, * EXCLUDE rn FROM {numbered('nation')}")
simple("id_numeric", "orders", lambda t: projection.add_id(t, prefix="", name="row"), f"SELECT rn AS row, * EXCLUDE rn FROM {numbered('orders')}")
simple("headers", "lineitem", lambda t: projection.headers(t, "key$"), "SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey']) AS header")
simple("schema", "nation", projection.schema, "SELECT * FROM (VALUES ('n_nationkey', 'Int32', true), ('n_name', 'Utf8', true), ('n_regionkey', 'Int32', true)) AS t(column_name, data_type, nullable)")


# Joins and unions
def joined(how: str, filtered: str | None = None):
    def run(spark, sf_dir):
        right = load(spark, sf_dir, "customer")
        if filtered:
            right = filtering.filter_where(right, filtered)
        return joining.merge(load(spark, sf_dir, "orders"), right, key_mapping="o_custkey=c_custkey", how=how).df

    return run


JOINED = "SELECT o.*, c.c_name AS r_c_name, c.c_nationkey AS r_c_nationkey, c.c_acctbal AS r_c_acctbal, c.c_mktsegment AS r_c_mktsegment FROM orders o {} JOIN (SELECT * FROM customer{}) c ON o.o_custkey = c.c_custkey"
query("join_inner", JOINED.format("", ""))(joined("inner"))
query("join_left", JOINED.format("LEFT", " WHERE c_mktsegment = 'BUILDING'"))(joined("left", "c_mktsegment=BUILDING"))
query("join_right", JOINED.format("RIGHT", ""))(joined("right"))


@query("join_same_key", "SELECT d.*, l.quality AS r_quality, l.toxic AS r_toxic FROM (SELECT doc_id, lang, source FROM documents) d JOIN labels l USING (doc_id)")
def join_same_key(spark, sf_dir):
    left = projection.select_columns(load(spark, sf_dir, "documents"), "doc_id,lang,source")
    return joining.merge(left, load(spark, sf_dir, "labels"), key="DOC_ID").df


@query("append_strict", "SELECT * FROM lineitem WHERE l_quantity < 10 UNION ALL SELECT * FROM lineitem WHERE l_quantity >= 40")
def append_strict(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem")
    return joining.append([filtering.filter_where(t, "l_quantity<10"), filtering.filter_where(t, "l_quantity>=40")]).df


@query("append_align", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT NULL, NULL, r_regionkey FROM region")
def append_align(spark, sf_dir):
    return joining.append([load(spark, sf_dir, "nation"), projection.rename(load(spark, sf_dir, "region"), "r_regionkey=N_REGIONKEY")], ignore_schema=True).df


@query("append_numbered", f"SELECT row_number() OVER (ORDER BY part, rn) AS id, n_name FROM (SELECT 0 AS part, rn, n_name FROM {numbered('nation')} UNION ALL SELECT 1, rn, n_name FROM {numbered('nation')})")
def append_numbered(spark, sf_dir):
    t = projection.select_columns(load(spark, sf_dir, "nation"), "n_name")
    return projection.add_id(joining.append([t, t]), prefix="", name="id").df


# Dedup
FIRST = "SELECT * EXCLUDE (rn, k) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY rn {}) AS k FROM {}) WHERE k = 1"
simple("dedup_first", "lineitem", lambda t: dedup.dedup_rows(t, "l_orderkey,l_linenumber"), FIRST.format("ASC", numbered("lineitem")))
simple("dedup_last", "lineitem", lambda t: dedup.dedup_rows(t, "l_orderkey,l_linenumber", "last"), FIRST.format("DESC", numbered("lineitem")))
simple("dedup_all", "lineitem", lambda t: dedup.dedup_rows(projection.select_columns(t, "l_returnflag,l_linestatus,l_linenumber")), "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
simple("dedup_last_turn", "conversations", lambda t: dedup.dedup_rows(t, "conv_id", "last"), f"SELECT * EXCLUDE (rn, k) FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rn DESC) AS k FROM {numbered('conversations')}) WHERE k = 1")
simple("dedup_nested", "embeddings", lambda t: dedup.dedup_rows(t, "label").select("vec_id", "label"), f"SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rn) AS k FROM {numbered('embeddings')}) WHERE k = 1")
simple("dedup_cols", "orders", lambda t: dedup.dedup_columns(projection.create(t, "copy=o_orderstatus,price=o_totalprice+0,other=o_custkey+1")), "SELECT *, o_custkey + 1 AS other FROM orders")


# Sorting: positions, so that the order itself is compared
def positions(t: Table) -> Table:
    return projection.add_id(t, prefix="", name="pos")


simple("sort_multi", "orders", lambda t: positions(sorting.sort(t, "o_orderstatus,o_totalprice", descending=[False, True])).select("pos", "o_orderkey"), f"SELECT row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, rn) AS pos, o_orderkey FROM {numbered('orders')}")
simple("sort_nulls", "lineitem", lambda t: positions(sorting.sort(with_nulls(t), "l_discount,l_returnflag", descending=[True, False], nulls="first")).select("pos", "l_orderkey", "l_discount"), f"SELECT row_number() OVER (ORDER BY l_discount DESC NULLS FIRST, l_returnflag NULLS FIRST, rn) AS pos, l_orderkey, l_discount FROM (SELECT *, row_number() OVER () AS rn FROM ({NULLED}))")
simple("sort_skip", "lineitem", lambda t: positions(sorting.sort(with_nulls(t), "l_discount", nulls="skip")).select("pos", "l_orderkey"), f"SELECT row_number() OVER (ORDER BY l_discount, rn) AS pos, l_orderkey FROM (SELECT *, row_number() OVER () AS rn FROM ({NULLED})) WHERE l_discount IS NOT NULL")
simple("sort_ci", "part", lambda t: positions(sorting.sort(t, "p_name", strategy="alphabetic", ignore_case=True)).select("pos", "p_partkey"), f"SELECT row_number() OVER (ORDER BY lower(p_name), rn) AS pos, p_partkey FROM {numbered('part')}")
simple("sort_numeric_str", "orders", lambda t: positions(sorting.sort(projection.create(t, "s=cast(o_custkey AS STRING)"), "s", strategy="numeric", descending=True)).select("pos", "o_orderkey"), f"SELECT row_number() OVER (ORDER BY o_custkey DESC, rn) AS pos, o_orderkey FROM {numbered('orders')}")
simple("sort_date_fmt", "orders", lambda t: positions(sorting.sort(projection.create(t, "d=date_format(o_orderdate, 'dd/MM/yyyy')"), "d", strategy="date", date_fmt="dd/mm/yyyy")).select("pos", "o_orderkey"), f"SELECT row_number() OVER (ORDER BY o_orderdate::DATE, rn) AS pos, o_orderkey FROM {numbered('orders')}")
simple("sort_hour", "events", lambda t: positions(sorting.sort(projection.create(t, "h=date_format(ts, 'HH:mm:ss')"), "h", strategy="hour", hour_fmt="hh:mm:ss")).select("pos", "event_id"), f"SELECT row_number() OVER (ORDER BY strftime(ts, '%H:%M:%S'), rn) AS pos, event_id FROM {numbered('events')}")
simple("sort_all", "nation", lambda t: positions(sorting.sort(t, "all", descending=True)), "SELECT row_number() OVER (ORDER BY n_nationkey DESC) AS pos, * FROM nation")

# Counts, pivots, statistics
simple("freq_one", "lineitem", lambda t: summaries.frequency(t, "l_returnflag"), "SELECT l_returnflag, count(*) AS frequency FROM lineitem GROUP BY 1")
simple("freq_multi", "lineitem", lambda t: summaries.frequency(t, "l_returnflag,l_linestatus"), "SELECT l_returnflag, l_linestatus, count(*) AS frequency FROM lineitem GROUP BY 1, 2")
simple("freq_pct", "events", lambda t: summaries.frequency(t, "event_type", percentage=True), "SELECT event_type, count(*) AS frequency, round(100 * count(*) / (SELECT count(*) FROM events), 1) AS percentage FROM events GROUP BY 1")
simple("distinct_values", "part", lambda t: summaries.distinct_values(t, "p_brand"), "SELECT DISTINCT p_brand FROM part")
simple("category_counts", "customer", lambda t: rounded(summaries.category_counts(t, "c_mktsegment")), "SELECT c_mktsegment, count(*) AS count, round(count(*) / (SELECT count(*) FROM customer), 4) AS share FROM customer GROUP BY 1")
for _agg, _sql in (("sum", "sum"), ("mean", "avg"), ("count", "count"), ("min", "min"), ("max", "max")):
    simple(f"pivot_{_agg}", "lineitem", lambda t, a=_agg: rounded(summaries.pivot(t, "l_returnflag", "l_linestatus", "l_quantity,l_extendedprice", a), 2), f"SELECT l_returnflag, l_linestatus, {', '.join(f'{_sql}({c}) AS {c}_{_agg}' if _agg == 'count' else f'round({_sql}({c}), 2) AS {c}_{_agg}' for c in ('l_quantity', 'l_extendedprice'))} FROM lineitem GROUP BY 1, 2")
simple("pivot_auto", "lineitem", lambda t: rounded(summaries.pivot(projection.select_columns(t, "l_returnflag,l_linestatus,l_shipdate,l_quantity,l_linenumber"), "l_returnflag", "l_linestatus"), 2), "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum, sum(l_linenumber)::BIGINT AS l_linenumber_sum FROM lineitem GROUP BY 1, 2")
simple("pivot_wide", "lineitem", lambda t: rounded(summaries.pivot(t, "l_linenumber", "l_returnflag", "l_quantity", "sum", fill=0, wide=True), 2), "SELECT l_linenumber, " + ", ".join(f"coalesce(round(sum(l_quantity) FILTER (WHERE l_returnflag = '{f}'), 2), 0) AS \"{f}\"" for f in "ANR") + " FROM lineitem GROUP BY 1")


def _stat_sql(exhaustive: bool) -> str:
    out = []
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"):
        q = {p: f"round(quantile_cont({c}, {p}), 4)" for p in (0.25, 0.5, 0.75)}
        if exhaustive:
            out.append(f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std_dev, round(min({c}), 4) AS min_val, {q[0.25]} AS q25, {q[0.5]} AS median, {q[0.75]} AS q75, round(max({c}), 4) AS max_val, round(var_pop({c}), 2) AS variance, count(DISTINCT {c}) AS num_classes, count({c}) - count(DISTINCT {c}) AS duplicates FROM lineitem")
        else:
            out.append(f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 4) AS mean, {q[0.25]} AS q25, {q[0.5]} AS q50, {q[0.75]} AS q75, count(DISTINCT {c}) AS num_classes FROM lineitem")
    for c in ("l_returnflag", "l_linestatus"):
        nulls = "NULL, " * (8 if exhaustive else 4)
        out.append(f"SELECT '{c}', count({c}), {nulls}count(DISTINCT {c}){f', count({c}) - count(DISTINCT {c})' if exhaustive else ''} FROM lineitem")
    return " UNION ALL ".join(out)


STAT_COLUMNS = "l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus"
simple("stats_basic", "lineitem", lambda t: rounded(summaries.stats(t, STAT_COLUMNS)), _stat_sql(False))
simple("stats_exhaustive", "lineitem", lambda t: rounded(summaries.stats(t, STAT_COLUMNS, "exhaustive").withColumn("variance", F.round("variance", 2))), _stat_sql(True))
simple("stats_wide", "lineitem", lambda t: summaries.stats(t).select("column_name", "count", "num_classes"), " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS count, count(DISTINCT {c}) AS num_classes FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")))
NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")
PAIRS = (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))
simple("corr_pearson", "lineitem", lambda t: correlation.correlations(t, ",".join(NUMBERS)), " UNION ALL ".join(f"SELECT '{a}' AS column1, '{b}' AS column2, round(corr({a}, {b}), 4) AS correlation FROM lineitem" for a, b in PAIRS))
simple("corr_matrix", "lineitem", lambda t: correlation.matrix(t, ",".join(NUMBERS)), " UNION ALL ".join("SELECT '{}' AS variable, {} FROM lineitem".format(a, ", ".join(f"{'1.0::DOUBLE' if a == b else f'round(corr({a}, {b}), 4)'} AS corr_with_{b}" for b in sorted(NUMBERS))) for a in sorted(NUMBERS)))
_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS {c}" for c in NUMBERS)
simple("corr_spearman", "lineitem", lambda t: correlation.correlations(t, ",".join(NUMBERS), "spearman"), f"WITH r AS (SELECT {_RANKS} FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS column1, '{b}' AS column2, round(corr({a}, {b}), 4) AS correlation FROM r" for a, b in PAIRS))
simple("corr_kendall", "supplier", lambda t: correlation.correlations(t, "s_nationkey,s_acctbal", "kendall"), "WITH r AS (SELECT *, row_number() OVER () AS rn FROM supplier), n AS (SELECT count(*) AS n FROM supplier) SELECT 's_nationkey' AS column1, 's_acctbal' AS column2, round(sum(sign(b.s_nationkey - a.s_nationkey) * sign(b.s_acctbal - a.s_acctbal)) / (max(n) * (max(n) - 1) / 2), 4) AS correlation FROM r a JOIN r b ON a.rn < b.rn, n")
simple("corr_tests", "lineitem", lambda t: correlation.correlations(t, ",".join(NUMBERS), tests=True))

# Outliers
for _name, _method in (("iqr", "iqr"), ("z", "z-score"), ("mz", "modified-z-score"), ("if", "isolation-forest")):
    _stats = {"iqr": "quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b", "z": "avg(value) AS a, stddev_samp(value) AS b", "mz": "median(value) AS a", "if": "avg(value) AS a, stddev_samp(value) AS b, min(value) AS lo, max(value) AS hi"}[_name]
    _more = ", m AS (SELECT median(abs(value - a)) AS b FROM events, s)" if _name == "mz" else ""
    _from = f"WITH s AS (SELECT {_stats} FROM events){_more} SELECT {{}} FROM events, s{', m' if _more else ''} WHERE {{}}"
    _test = {"iqr": "value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)", "z": "abs((value - a) / b) > 3", "mz": "abs(0.6745 * (value - a) / b) > 3", "if": "abs(value - a) / b > 2.5 AND (value < lo + 0.1 * (hi - lo) OR value > hi - 0.1 * (hi - lo))"}[_name]
    simple(f"outlier_{_name}_flag", "events", lambda t, m=_method: outliers.detect(t, "value", m), _from.format(f"'value' AS column_name, true AS is_outlier, '{_method}' AS method", _test))
    simple(f"outlier_{_name}_remove", "events", lambda t, m=_method: outliers.remove(t, "value", m), _from.format("events.*", f"NOT ({_test})"))
    _score = {"iqr": "printf('bounds: %.3f to %.3f', a - 1.5 * (b - a), b + 1.5 * (b - a)) AS bounds", "z": "round(abs((value - a) / b), 4) AS z_score", "mz": "round(0.6745 * (value - a) / b, 4) AS modified_z_score", "if": "round(abs(value - a) / b, 4) AS isolation_score"}[_name]
    simple(f"outlier_{_name}_values", "events", lambda t, m=_method: rounded(outliers.detect(t, "value", m, show_values=True)), _from.format(f"'value' AS column_name, round(value, 4) AS value, {_score}, '{_method}' AS method", _test))
simple("outlier_row_numbers", "events", lambda t: outliers.detect(t, "value", "z-score", row_numbers=True), f"WITH s AS (SELECT avg(value) AS a, stddev_samp(value) AS b FROM events) SELECT rn AS row_number, 'value' AS column_name, true AS is_outlier, 'z-score' AS method FROM {numbered('events')}, s WHERE abs((value - a) / b) > 3")

# Missing values
simple("fill_value", "lineitem", lambda t: filling.fill(with_nulls(t), "value", "0"), f"SELECT * REPLACE (coalesce(l_discount, 0) AS l_discount, coalesce(l_returnflag, '0') AS l_returnflag) FROM ({NULLED})")
simple("fill_mean", "lineitem", lambda t: rounded(filling.fill(with_nulls(t), "mean", columns="l_discount").df), f"SELECT * REPLACE (round(coalesce(l_discount, (SELECT avg(l_discount) FROM ({NULLED}))), 4) AS l_discount) FROM ({NULLED})")
simple("fill_median", "lineitem", lambda t: rounded(filling.fill(with_nulls(t), "median", columns="l_discount,l_tax").df), f"SELECT * REPLACE (round(coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM ({NULLED}))), 4) AS l_discount) FROM ({NULLED})")
simple("fill_mode", "lineitem", lambda t: filling.fill(with_nulls(t), "mode", columns="l_discount,l_returnflag"), "WITH t AS (" + NULLED + ") SELECT * REPLACE (coalesce(l_discount, (SELECT l_discount FROM t WHERE l_discount IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_discount, coalesce(l_returnflag, (SELECT l_returnflag FROM t WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag) FROM t")
simple("fill_forward", "lineitem", lambda t: filling.fill_direction(with_nulls(t), "forward", block=1000), f"SELECT * EXCLUDE rn REPLACE (last_value(l_discount IGNORE NULLS) OVER w AS l_discount, last_value(l_returnflag IGNORE NULLS) OVER w AS l_returnflag) FROM (SELECT *, row_number() OVER () AS rn FROM ({NULLED})) WINDOW w AS (ORDER BY rn)")
simple("fill_backward", "lineitem", lambda t: filling.fill(with_nulls(t), "backward"), f"SELECT * EXCLUDE rn REPLACE (last_value(l_discount IGNORE NULLS) OVER w AS l_discount, last_value(l_returnflag IGNORE NULLS) OVER w AS l_returnflag) FROM (SELECT *, row_number() OVER () AS rn FROM ({NULLED})) WINDOW w AS (ORDER BY rn DESC)")


# Bins
def _case(c: str, edges: list[float], labels: list[str] | None = None) -> str:
    parts = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        text = labels[i] if labels else f"[{lo:.2f}, {hi:.2f})"
        parts.append(f"WHEN {c} >= {lo} AND {c} {'<=' if i == len(edges) - 2 else '<'} {hi} THEN '{text}'")
    return f"CASE {' '.join(parts)} ELSE 'NULL' END"


simple("bin_width", "lineitem", lambda t: binning.bin_columns(projection.select_columns(t, "l_orderkey,l_quantity"), "l_quantity", 7), f"SELECT l_orderkey, l_quantity, {_case('l_quantity', [1 + 49 * k / 7 for k in range(7)] + [50])} AS l_quantity_binned FROM lineitem")
simple("bin_lowest", "lineitem", lambda t: binning.bin_columns(projection.select_columns(t, "l_orderkey,l_quantity"), "l_quantity", "2,10,40", "custom", include_lowest=True), f"SELECT l_orderkey, l_quantity, {_case('l_quantity', [2 - 1e-10, 10, 40])} AS l_quantity_binned FROM lineitem")
simple("bin_custom_labels", "lineitem", lambda t: binning.bin_columns(projection.select_columns(t, "l_orderkey,l_quantity"), "l_quantity", "5,20,35", "custom", labels="low,high"), f"SELECT l_orderkey, l_quantity, {_case('l_quantity', [5, 20, 35], ['low', 'high'])} AS l_quantity_binned FROM lineitem")
simple("bin_multi", "lineitem", lambda t: binning.bin_columns(projection.select_columns(t, "l_orderkey,l_quantity,l_linenumber"), "l_quantity,l_linenumber", "1,3,5,40", suffix="_b", drop_original=True), f"SELECT l_orderkey, {_case('l_quantity', [1, 3, 5, 40])} AS l_quantity_b, {_case('l_linenumber', [1, 3, 5, 40])} AS l_linenumber_b FROM lineitem")
simple("bin_freq", "lineitem", lambda t: binning.bin_columns(projection.select_columns(t, "l_orderkey,l_quantity"), "l_quantity", 4, "equal-frequency", labels="q1,q2,q3,q4"), "WITH e AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS q FROM lineitem) SELECT l_orderkey, l_quantity, CASE WHEN l_quantity < q[1] THEN 'q1' WHEN l_quantity < q[2] THEN 'q2' WHEN l_quantity < q[3] THEN 'q3' ELSE 'q4' END AS l_quantity_binned FROM lineitem, e")

# Samples
simple("sample_random", "orders", lambda t: sampling.sample(t, 100, seed=SEED), f"SELECT * EXCLUDE rn FROM {numbered('orders')} ORDER BY {HASHED}, rn LIMIT 100")
simple("preview", "orders", lambda t: sampling.preview(t, 5, seed=SEED), f"SELECT * EXCLUDE rn FROM {numbered('orders')} ORDER BY {HASHED}, rn LIMIT 5")
simple("sample_first", "orders", lambda t: sampling.sample(t, 20, "first"), f"SELECT * EXCLUDE rn FROM {numbered('orders')} WHERE rn <= 20")
simple("sample_last", "orders", lambda t: sampling.sample(t, 20, "last"), f"SELECT * EXCLUDE rn FROM {numbered('orders')} WHERE rn > (SELECT count(*) - 20 FROM orders)")
simple("sample_strat", "customer", lambda t: sampling.sample(t, 200, "stratified", "c_mktsegment", SEED), f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {HASHED}, rn) AS k FROM {numbered('customer')}),
z AS (SELECT c_mktsegment AS s, 200 * count(*) / (SELECT count(*) FROM customer) AS exact FROM customer GROUP BY 1),
q AS (SELECT s, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, s) <= 200 - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM z)
SELECT t.* EXCLUDE (rn, k) FROM t JOIN q ON s = c_mktsegment WHERE k <= quota""")
simple("shuffle_seeded", "orders", lambda t: positions(sampling.shuffle(t, SEED)).select("pos", "o_orderkey"), f"SELECT row_number() OVER (ORDER BY {HASHED}, rn) AS pos, o_orderkey FROM {numbered('orders')}")
_SPLIT = f"SELECT * EXCLUDE (rn, k) FROM (SELECT *, row_number() OVER (ORDER BY {HASHED}, rn) AS k FROM {numbered('orders')}) WHERE k {{}} round(0.7 * (SELECT count(*) FROM orders))"
simple("split_train", "orders", lambda t: sampling.split(t, "0.7,0.3", seed=SEED)[0], _SPLIT.format("<="))
simple("split_test", "orders", lambda t: sampling.split(t, "70,30", seed=SEED)[1], _SPLIT.format(">"))
simple("split_strat", "orders", lambda t: sampling.split(t, "0.6,0.4", "o_orderstatus", SEED)[0], f"SELECT * EXCLUDE (rn, k, n) FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASHED}, rn) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM {numbered('orders')}) WHERE k <= round(n * 0.6)")

# Sizes and metadata
simple("size", "nation", lambda t: sizes.size(t, per_column=True, per_row=True), "SELECT * FROM (VALUES ('total_rows', '25'), ('total_columns', '3'), ('memory_size', '800 B'), ('average_row_size', '32 B'), ('column_n_nationkey', '100 B'), ('column_n_name', '600 B'), ('column_n_regionkey', '100 B')) AS t(metric, value)")

#: What DuckDB reads in the same footer; the file has the same bytes at every scale.
_FOOTER = "/root/testdata/sf0.01/nation.parquet"
_PER_CENT = "printf('%.2f%%', 100.0 * {} / {})"
_CHUNKS = f"(SELECT *, total_compressed_size AS a, total_uncompressed_size AS b FROM parquet_metadata('{_FOOTER}'))"


def _listed(rows: str, prefix: str, **values: str) -> str:
    """(key, value) rows of some expressions over ``rows``."""
    return f"SELECT {prefix} || unnest([{', '.join(repr(k) for k in values)}]) AS key, unnest([{', '.join(f'({v})::VARCHAR' for v in values.values())}]) AS value FROM {rows}"


_BASIC = _listed(
    f"parquet_file_metadata('{_FOOTER}'), (SELECT sum(a) AS a, sum(b) AS b, count(DISTINCT column_id) AS columns FROM {_CHUNKS}), (SELECT count(*) AS pairs FROM parquet_kv_metadata('{_FOOTER}'))",
    "''",
    file_version="'2.6'",
    created_by="created_by",
    total_rows="num_rows",
    num_row_groups="num_row_groups",
    num_columns="columns",
    total_compressed_size="a",
    total_uncompressed_size="b",
    compression_ratio=_PER_CENT.format("a", "b"),
    schema_name="'schema'",
    schema_num_fields="columns",
    key_value_metadata_count="pairs",
)
_BASIC += f" UNION ALL SELECT 'metadata_' || decode(key), decode(value) FROM parquet_kv_metadata('{_FOOTER}')"
_ENCODINGS = f"(SELECT e, count(*) AS n, sum(count(*)) OVER () AS every FROM (SELECT unnest(string_split(encodings, ', ')) AS e FROM {_CHUNKS}) GROUP BY e)"
_PARTS_SQL = {
    "basic": None,
    "schema": _listed(
        f"(SELECT *, row_number() OVER (ORDER BY column_id) - 1 AS i, repetition_type = 'OPTIONAL' AS optional FROM parquet_schema('{_FOOTER}') WHERE type IS NOT NULL)",
        "'column_' || i || '_'",
        name="name",
        physical_type="type",
        logical_type="CASE WHEN logical_type LIKE 'StringType%' THEN 'STRING' ELSE coalesce(logical_type, 'NONE') END",
        max_definition_level="optional::INT",
        max_repetition_level="(repetition_type = 'REPEATED')::INT",
        is_optional="optional",
        converted_type="coalesce(converted_type, 'NONE')",
        precision="coalesce(precision, -1)",
        scale="coalesce(scale, -1)",
        length="coalesce(type_length, '0')",
    ),
    "row_groups": _listed(f"(SELECT row_group_id AS i, any_value(row_group_num_rows) AS n, any_value(row_group_bytes) AS b, sum(a) AS a, count(*) AS columns FROM {_CHUNKS} GROUP BY 1)", "'row_group_' || i || '_'", num_rows="n", total_byte_size="b", compressed_size="a", num_columns="columns", compression_ratio=_PER_CENT.format("a", "b")),
    "column_chunks": _listed(
        _CHUNKS,
        "'rg_' || row_group_id || '_col_' || column_id || '_'",
        path="path_in_schema",
        type="type",
        encodings="replace(encodings, ', ', ',')",
        compression="compression",
        uncompressed_size="b",
        compressed_size="a",
        num_values="num_values",
        compression_ratio=_PER_CENT.format("a", "b"),
        null_count="stats_null_count",
        distinct_count="coalesce(stats_distinct_count::VARCHAR, 'N/A')",
        min="stats_min_value",
        max="stats_max_value",
    ),
    "compression": _listed(f"(SELECT compression AS codec, sum(a) AS a, sum(b) AS b, count(*) AS n FROM {_CHUNKS} GROUP BY 1)", "'compression_' || codec || '_'", compressed_size="a", uncompressed_size="b", chunk_count="n", ratio=_PER_CENT.format("a", "b")) + f" UNION ALL SELECT 'overall_compression_ratio', {_PER_CENT.format('sum(a)', 'sum(b)')} FROM {_CHUNKS}",
    "encoding": _listed(_ENCODINGS, "'encoding_' || e || '_'", usage_count="n", percentage=_PER_CENT.format("n", "every")),
    "statistics": _listed(f"(SELECT count(*) AS n, count(stats_min_value) AS have, sum(stats_null_count) AS nulls, count(stats_distinct_count) AS classes FROM {_CHUNKS})", "'statistics_'", total_chunks="n", with_statistics="have", coverage=_PER_CENT.format("have", "n"), total_null_count="nulls", chunks_with_distinct_count="classes"),
}
for _part, _own in _PARTS_SQL.items():
    query(f"metadata_{_part}", _BASIC + (f" UNION ALL {_own}" if _own else ""))(lambda spark, sf_dir, p=_part: footer.metadata(spark, f"{sf_dir}/nation.parquet", () if p == "basic" else (p,)))


@query("footer_count", "SELECT count(*) AS row_count FROM lineitem")
def footer_count(spark, sf_dir):
    return spark.createDataFrame([(footer.count(spark, f"{sf_dir}/lineitem.parquet"),)], "row_count bigint")


# Files: written under the session's shared folder, and read back
def _written(fmt: str, table: str, schema: str, **options):
    def run(spark, sf_dir):
        path = f"{store.shared_folder(spark)}/files/{uuid.uuid4().hex}.{fmt}"
        files.write(load(spark, sf_dir, table), path, fmt, single_file=False, options=options)
        return files.read(spark, path, fmt, schema).df

    return run


_NATION = "n_nationkey int, n_name string, n_regionkey int"
query("convert_csv", "SELECT * FROM nation")(_written("csv", "nation", _NATION))
query("convert_json", "SELECT * FROM nation")(_written("json", "nation", _NATION))
query("optimize_zstd", "SELECT * FROM nation")(_written("parquet", "nation", _NATION, **files.optimize_options("zstd", 3)))


@query("optimize_sorted", "SELECT row_number() OVER (ORDER BY n_name) AS pos, * FROM nation")
def optimize_sorted(spark, sf_dir):
    """Sorted and encoded anew; the rows, read back, are in that order."""
    path = f"{store.shared_folder(spark)}/files/{uuid.uuid4().hex}.parquet"
    return positions(files.read(spark, files.optimize(spark, f"{sf_dir}/nation.parquet", path, "gzip", 9, sort_by="n_name"))).df


# The row-local operators on a stream, and windowed counts with a watermark
@query("stream_filter", "SELECT event_id, event_type, value, value * 2 AS twice FROM events WHERE value >= 100")
def stream_filter(spark, sf_dir):
    return streaming.run_to_table(streaming.pipeline(streaming.read(spark, sf_dir, "events"), keep="value>=100", create="twice=value*2", columns="event_id,event_type,value,twice"))


@query("stream_frequency", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS frequency FROM events GROUP BY ALL")
def stream_frequency(spark, sf_dir):
    return streaming.run_to_table(streaming.frequency(streaming.read(spark, sf_dir, "events"), "ts", "event_type", "1 day", "2 days"), mode="complete")


__all__ = ["ORACLE_SQL", "QUERIES", "load"]
