"""Named queries over the star-schema tables, each with SQL of the same meaning for a check against DuckDB where SQL can express it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as E
from .functions import names, questions
from .operators import answers, charts, cleaning, encoders, explain, features, insights, meta_features, metrics, models, profile, quantiles, scoring, tuning
from .operators.charts import ChartSpec
from .operators.ordered import shared_folder
from .sources import cache, files
from .streaming import windows

_QUERIES: dict[str, tuple[Callable[[Callable[[str], DataFrame]], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        _QUERIES[name] = (f, sql)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f):
        return lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    return {name: bind(f) for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and role of each column of ``lineitem``."""
    return profile.roles(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def r(c, places: int = 4):
    """Rounded, as both engines can."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), places)


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: r(c, places) for c in columns})


# ---- Group aggregates (A1-A5, A9-A11, F1-F3, O1-O4) --------------------------------------------------------------

@query("q01_sum_sorted", "SELECT l_returnflag, round(sum(l_quantity), 4) AS value FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def q01(t):
    return rounded(charts.build(t("lineitem"), ChartSpec("bar", "l_returnflag", "l_quantity", sort_by="y_desc", top_n=12)), "value")


@query("q02_mean", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1")
def q02(t):
    return rounded(charts.build(t("orders"), ChartSpec("bar", "o_orderpriority", "o_totalprice", agg="mean")), "value")


def _gaps(df: DataFrame, column: str, key: str, every: int) -> DataFrame:
    return df.withColumn(column, F.when(F.col(key) % every != 0, F.col(column)))


@query("q03_count_guarded", "SELECT l_returnflag, count(q) AS value FROM (SELECT l_returnflag, CASE WHEN l_orderkey % 25 <> 0 THEN l_quantity END AS q FROM lineitem) WHERE q IS NOT NULL GROUP BY 1")
def q03(t):
    return charts.build(_gaps(t("lineitem"), "l_quantity", "l_orderkey", 25), ChartSpec("bar", "l_returnflag", "l_quantity", agg="count"))


@query("q04_median", "SELECT o_orderstatus, round(median(o_totalprice), 4) AS value FROM orders GROUP BY 1")
def q04(t):
    return rounded(charts.build(t("orders"), ChartSpec("bar", "o_orderstatus", "o_totalprice", agg="median")), "value")


@query("q05_min_max", "SELECT c_mktsegment, round(min(c_acctbal), 4) AS low, round(max(c_acctbal), 4) AS high FROM customer GROUP BY 1")
def q05(t):
    low, high = (charts.build(t("customer"), ChartSpec("bar", "c_mktsegment", "c_acctbal", agg=a)).withColumnRenamed("value", n) for a, n in (("min", "low"), ("max", "high")))
    return rounded(low.join(high, "c_mktsegment"), "low", "high")


@query("q06_two_keys", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2")
def q06(t):
    return rounded(charts.build(t("lineitem"), ChartSpec("bar", "l_returnflag", "l_extendedprice", color="l_linestatus")), "value", places=2)


@query("q07_group_size", "SELECT event_type, count(*) AS value FROM events GROUP BY 1")
def q07(t):
    return charts.build(t("events"), ChartSpec("bar", "event_type"))


@query("q08_two_key_count", "SELECT o_orderstatus, o_orderpriority, count(*) AS value FROM orders GROUP BY 1, 2")
def q08(t):
    return charts.build(t("orders"), ChartSpec("bar", "o_orderstatus", color="o_orderpriority"))


# ---- Time buckets (A6-A8) ----------------------------------------------------------------------------------------

@query("q09_monthly_sum", "SELECT strftime(o_orderdate, '%Y-%m') AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def q09(t):
    return rounded(charts.build(t("orders"), ChartSpec("time_series", "o_orderdate", "o_totalprice", granularity="monthly")), "value", places=2)


@query("q10_weekly_mean", """SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS period,
    round(avg(value), 4) AS value FROM events GROUP BY 1""")
def q10(t):
    return rounded(charts.build(t("events"), ChartSpec("time_series", "ts", "value", agg="mean", granularity="weekly")), "value")


@query("q11_quarterly_sum", "SELECT CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def q11(t):
    return rounded(charts.build(t("orders"), ChartSpec("time_series", "o_orderdate", "o_totalprice", granularity="quarterly")), "value", places=2)


@query("q12_yearly_daily", """SELECT 'yearly' AS every, CAST(year(o_orderdate) AS VARCHAR) AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 2
    UNION ALL SELECT 'daily', strftime(ts, '%Y-%m-%d'), round(sum(value), 2) FROM events GROUP BY 2""")
def q12(t):
    yearly = charts.build(t("orders"), ChartSpec("time_series", "o_orderdate", "o_totalprice", granularity="yearly"))
    daily = charts.build(t("events"), ChartSpec("time_series", "ts", "value", granularity="daily"))
    return rounded(yearly.select(F.lit("yearly").alias("every"), "*").union(daily.select(F.lit("daily"), "*")), "value", places=2)


@query("q13_monthly_by_type", "SELECT strftime(ts, '%Y-%m') AS period, event_type, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def q13(t):
    return rounded(charts.build(t("events"), ChartSpec("time_series", "ts", "value", color="event_type", granularity="monthly")), "value")


@query("q14_monthly_count_filtered", "SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def q14(t):
    return charts.build(t("orders"), ChartSpec("time_series", "o_orderdate", granularity="monthly", filter_col="o_orderstatus", filter_val="F"))


# ---- Filters (F1-F3) ---------------------------------------------------------------------------------------------

_TIERS = ("ECONOMY", "economy", "econ", "economy brushed")


@query("q15_fuzzy_filter", " UNION ALL ".join(f"""SELECT '{v}' AS wanted, count(*) AS n, min(tier) AS tier FROM (SELECT tier, min(tier) OVER () AS best FROM (SELECT CASE WHEN p_type = '{v}' THEN 1
    WHEN lower(p_type) = '{v.lower()}' THEN 2 WHEN contains(lower(p_type), '{v.lower()}') THEN 3 WHEN contains('{v.lower()}', lower(p_type)) THEN 4 END AS tier FROM part)) WHERE tier = best""" for v in _TIERS))
def q15(t):
    out = None
    for v in _TIERS:
        low = F.lower("p_type")
        tier = F.when(F.col("p_type") == v, 1).when(low == v.lower(), 2).when(low.contains(v.lower()), 3).otherwise(4)
        part = charts.fuzzy_filter(t("part"), "p_type", v).agg(F.count("*").alias("n"), F.min(tier).alias("tier")).select(F.lit(v).alias("wanted"), "n", "tier")
        out = part if out is None else out.union(part)
    return out


@query("q16_any_value", "SELECT c_mktsegment, count(*) AS value FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery') GROUP BY 1")
def q16(t):
    return charts.build(t("customer"), ChartSpec("bar", "c_mktsegment", filter_col="c_mktsegment", filter_values=("Building", "MACHINERY")))


@query("q17_string_equality", "SELECT l_returnflag, count(*) AS value FROM lineitem WHERE CAST(l_linenumber AS VARCHAR) = '4' GROUP BY 1")
def q17(t):
    return charts.build(charts.equal_filter(t("lineitem"), "l_linenumber", "4"), ChartSpec("bar", "l_returnflag"))


@query("q18_bottom_n", "SELECT s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier ORDER BY s_acctbal, s_name LIMIT 10")
def q18(t):
    return charts.build(t("supplier"), ChartSpec("bar", "s_name", "s_acctbal", agg="min", sort_by="y_asc", top_n=10)).select("s_name", r("value", 2).alias("s_acctbal"))


@query("q19_value_shares", "SELECT c_mktsegment AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1")
def q19(t):
    return rounded(charts.value_counts(t("customer"), "c_mktsegment"), "share", places=6)


_TOP = " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value FROM part" for c in ("p_brand", "p_type", "p_size"))


@query("q20_top_values", f"SELECT name, value, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS rank FROM (SELECT name, value, count(*) AS n FROM ({_TOP}) GROUP BY 1, 2)) WHERE rank <= 5")
def q20(t):
    return charts.top_values(t("part"), ["p_brand", "p_type", "p_size"])


@query("q21_contingency", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\" FROM lineitem GROUP BY 1")
def q21(t):
    return charts.contingency(t("lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("q22_best_worst", """WITH g AS (SELECT o_orderpriority AS key, avg(o_totalprice) AS value, count(*) AS n FROM orders GROUP BY 1)
    (SELECT 'best' AS side, key, round(value, 4) AS value, n FROM g ORDER BY g.value DESC, key LIMIT 1) UNION ALL (SELECT 'worst', key, round(value, 4), n FROM g ORDER BY g.value, key LIMIT 1)""")
def q22(t):
    return rounded(charts.extremes(t("orders"), "o_orderpriority", "o_totalprice"), "value")


@query("q23_shares", """WITH g AS (SELECT c_mktsegment AS key, sum(c_acctbal) AS value FROM customer GROUP BY 1)
    SELECT key, round(value, 2) AS value, round(value / (SELECT sum(value) FROM g), 6) AS share, round((SELECT sum(value) FROM (SELECT value FROM g ORDER BY value DESC, key LIMIT 3)) / (SELECT sum(value) FROM g), 6) AS top3_share FROM g""")
def q23(t):
    return rounded(rounded(charts.shares(t("customer"), "c_mktsegment", "c_acctbal"), "value", places=2), "share", "top3_share", places=6)


@query("q24_spread_ratio", "SELECT round(max(sd) / min(sd), 6) AS spread_ratio, count(*) AS n_groups FROM (SELECT stddev_samp(o_totalprice) AS sd FROM orders GROUP BY o_orderpriority) WHERE sd > 0")
def q24(t):
    return rounded(charts.spread_ratio(t("orders"), "o_orderpriority", "o_totalprice"), "spread_ratio", places=6)


@query("q25_trend", """SELECT user_id, round(arg_min(value, (ts, event_id)), 4) AS first, round(arg_max(value, (ts, event_id)), 4) AS last, round(max(value), 4) AS peak, round(min(value), 4) AS low,
    round(100 * (arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))) / nullif(abs(arg_min(value, (ts, event_id))), 0), 3) AS change_pct FROM events GROUP BY 1""")
def q25(t):
    return rounded(rounded(charts.trend(t("events"), "ts", "value", "event_id", "user_id"), "first", "last", "peak", "low"), "change_pct", places=3)


@query("q26_trend_line", """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, corr(l_extendedprice, l_quantity) AS r, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem)
    SELECT round(lo + (hi - lo) * n / 79, 4) AS x, round(i + s * (lo + (hi - lo) * n / 79), 2) AS y, round(s, 4) AS slope, round(i, 2) AS intercept, round(r, 6) AS r, CASE WHEN abs(r) >= 0.6 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM f, range(80) AS x(n)""")
def q26(t):
    return charts.trend_line(t("lineitem"), "l_quantity", "l_extendedprice").select(r("x").alias("x"), r("y", 2).alias("y"), r("slope").alias("slope"), r("intercept", 2).alias("intercept"), r("r", 6).alias("r"), "strength")


@query("q27_histogram", """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 30), 29) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1""")
def q27(t):
    return charts.build(t("lineitem"), ChartSpec("histogram", "l_extendedprice")).select("bin", "n")


@query("q28_box", """WITH q AS (SELECT o_orderpriority AS grp, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1)
    SELECT grp, round(min(q1), 4) AS q1, round(min(m), 4) AS median, round(min(q3), 4) AS q3, round(min(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS low,
    round(max(o_totalprice) FILTER (o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS high, count(*) FILTER (o_totalprice NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers, count(*) AS n
    FROM orders JOIN q ON o_orderpriority = grp GROUP BY 1""")
def q28(t):
    return rounded(charts.build(t("orders"), ChartSpec("box", "o_orderpriority", "o_totalprice")), "q1", "median", "q3", "low", "high")


@query("q29_scalars", "SELECT round(sum(p_retailprice), 2) AS sum, round(avg(p_retailprice), 4) AS mean, round(median(p_retailprice), 4) AS median, min(p_retailprice) AS min, max(p_retailprice) AS max, count(p_retailprice) AS count FROM part")
def q29(t):
    return rounded(rounded(charts.scalars(t("part"), "p_retailprice"), "sum", places=2), "mean", "median")


@query("q30_fixed_sample", "SELECT event_id, event_type FROM events ORDER BY (event_id * 7919) % 10007, event_id LIMIT 500")
def q30(t):
    return t("events").orderBy((F.col("event_id") * 7919) % 10007, "event_id").limit(500).select("event_id", "event_type")


# ---- Profile and quality (A12-A19, C1-C11, C36, C38, W1, F8-F11) --------------------------------------------------

def _lineitem_gaps(t):
    return _gaps(_gaps(t("lineitem"), "l_quantity", "l_orderkey", 25), "l_tax", "l_partkey", 5)


@query("q31_missing", """SELECT 'l_quantity' AS name, count(*) AS rows, count(*) FILTER (l_orderkey % 25 = 0) AS missing FROM lineitem
    UNION ALL SELECT 'l_tax', count(*), count(*) FILTER (l_partkey % 5 = 0) FROM lineitem""")
def q31(t):
    return profile.column_stats(_lineitem_gaps(t).select("l_quantity", "l_tax"), wanted=()).select("name", "rows", "missing")


@query("q32_duplicates", "SELECT count(*) AS rows, count(DISTINCT text) AS distinct_rows, count(*) - count(DISTINCT text) AS duplicates FROM documents")
def q32(t):
    return profile.duplicates(t("documents").select("text"))


_NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _per(template: str, columns=_NUM) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


@query("q33_describe", _per("""SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 4) AS q1,
    round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, max({c}) AS max FROM lineitem"""))
def q33(t):
    stats = profile.column_stats(t("lineitem").select(*_NUM)).withColumn("n", F.col("rows") - F.col("missing"))
    return rounded(stats.select("name", "n", "mean", "std", "min", "q1", "median", "q3", "max"), "mean", "std", "q1", "median", "q3")


@query("q34_moments", _per("SELECT '{c}' AS name, round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurtosis FROM lineitem"))
def q34(t):
    return rounded(profile.column_stats(t("lineitem").select(*_NUM), wanted=("skew", "kurtosis")).select("name", "skew", "kurtosis"), "skew", "kurtosis", places=6)


@query("q35_text_measures", r"SELECT round(avg(len(regexp_split_to_array(trim(text), '\s+'))), 4) AS tokens, round(avg(length(text)), 4) AS length FROM documents")
def q35(t):
    return rounded(profile.column_stats(t("documents").select("text"), wanted=("tokens", "length")).select("tokens", "length"), "tokens", "length")


_PAIRS = [(a, b) for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in _PAIRS)


@query("q36_correlations", f"SELECT a, b, round(r, 6) AS r FROM ({_CORR})")
def q36(t):
    return rounded(charts.correlation_pairs(t("lineitem"), list(_NUM)), "r", places=6)


@query("q37_strongest_pair", f"SELECT a, b, round(r, 6) AS r FROM ({_CORR}) ORDER BY abs(r) DESC, a, b LIMIT 1")
def q37(t):
    return rounded(charts.correlation_pairs(t("lineitem"), list(_NUM)).orderBy(F.desc(F.abs("r")), "a", "b").limit(1), "r", places=6)


def _customer_gaps(t):
    return _gaps(t("customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", "c_custkey", 5)


@query("q38_quality_score", """WITH d AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS c_acctbal FROM customer),
    s AS (SELECT count(*) FILTER (c_acctbal IS NULL) / (3.0 * count(*)) AS missing_share, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d))) / count(*) AS duplicate_share,
    CAST(count(DISTINCT c_custkey) = 1 AS INT) + CAST(count(DISTINCT c_mktsegment) = 1 AS INT) + CAST(count(DISTINCT c_acctbal) = 1 AS INT) AS constant, CAST(count(DISTINCT c_mktsegment) > 0.9 * count(*) AS INT) AS near_unique FROM d)
    SELECT CAST(floor(100 - 30 * missing_share - 20 * duplicate_share - 20 * constant / 3.0 - 5 * near_unique) AS INTEGER) AS score, round(missing_share, 6) AS missing_share, round(duplicate_share, 6) AS duplicate_share, CAST(constant AS BIGINT) AS constant, CAST(near_unique AS BIGINT) AS near_unique FROM s""")
def q38(t):
    return rounded(profile.quality_score(_customer_gaps(t)), "missing_share", "duplicate_share", places=6)


def _skewed(t):
    """Orders with a few far prices and a column that is mostly zero."""
    return t("orders").select((F.when(F.col("o_orderkey") % 500 == 0, F.col("o_totalprice") * 50).otherwise(F.col("o_totalprice"))).alias("price"), F.when(F.col("o_orderkey") % 10 == 0, 5.0).otherwise(0.0).alias("fee"))


@query("q39_anomalies", """WITH d AS (SELECT CASE WHEN o_orderkey % 500 = 0 THEN o_totalprice * 50 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 10 = 0 THEN 5.0 ELSE 0.0 END AS fee FROM orders),
    u AS (SELECT 'price' AS name, price AS v FROM d UNION ALL SELECT 'fee', fee FROM d),
    s AS (SELECT name, quantile_cont(v, 0.25) AS q1, median(v) AS m, quantile_cont(v, 0.75) AS q3, min(v) AS lo, max(v) AS hi, avg(v) AS a, stddev_samp(v) AS sd, count(DISTINCT v) AS k FROM u GROUP BY 1),
    t AS (SELECT name, max(n) / sum(n) AS share FROM (SELECT name, v, count(*) AS n FROM u GROUP BY 1, 2) GROUP BY 1)
    SELECT name, 'extreme_high_outlier' AS anomaly, 'high' AS severity FROM s WHERE q3 > q1 AND hi > q3 + 3 * (q3 - q1) UNION ALL SELECT name, 'extreme_low_outlier', 'high' FROM s WHERE q3 > q1 AND lo < q1 - 3 * (q3 - q1)
    UNION ALL SELECT name, 'heavy_skew', 'medium' FROM s WHERE sd > 0 AND abs(a - m) > 2 * sd UNION ALL SELECT name, 'high_variability', 'medium' FROM s WHERE abs(sd / nullif(a, 0)) > 2
    UNION ALL SELECT name, 'dominant_value', 'low' FROM s JOIN t USING (name) WHERE share > 0.5 AND k > 1""")
def q39(t):
    return profile.anomalies(_skewed(t))


def _variants(t):
    seg = F.when(F.col("c_custkey") % 3 == 0, F.upper("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.lower("c_mktsegment")).otherwise(F.initcap("c_mktsegment"))
    return t("customer").select("c_custkey", seg.alias("segment"))


_VARIANTS = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) WHEN c_custkey % 3 = 1 THEN lower(c_mktsegment) ELSE upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS segment FROM customer"


@query("q40_uniformity", f"SELECT lower(trim(segment)) AS canon, string_agg(DISTINCT segment, '|' ORDER BY segment) AS variants, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT segment) AS INTEGER) AS n_variants FROM ({_VARIANTS}) GROUP BY 1 HAVING count(DISTINCT segment) > 1")
def q40(t):
    return profile.uniformity(_variants(t), "segment").select("canon", F.concat_ws("|", "variants").alias("variants"), "n", "n_variants")


@query("q41_roles", """SELECT 'p_brand' AS name, count(DISTINCT p_brand) AS "distinct", CASE WHEN count(DISTINCT p_brand) > 0.95 * count(*) THEN 'id' ELSE 'categorical' END AS role FROM part
    UNION ALL SELECT 'p_name', count(DISTINCT p_name), CASE WHEN count(DISTINCT p_name) > 0.95 * count(*) THEN 'id' ELSE 'categorical' END FROM part
    UNION ALL SELECT 'p_size', count(DISTINCT p_size), CASE WHEN count(DISTINCT p_size) <= 20 AND count(DISTINCT p_size) < 0.05 * count(*) THEN 'categorical' ELSE 'numeric' END FROM part
    UNION ALL SELECT 'p_retailprice', count(DISTINCT p_retailprice), CASE WHEN count(DISTINCT p_retailprice) <= 20 AND count(DISTINCT p_retailprice) < 0.05 * count(*) THEN 'categorical' ELSE 'numeric' END FROM part""")
def q41(t):
    return profile.roles(t("part").select("p_brand", "p_name", "p_size", "p_retailprice")).select("name", "distinct", "role")


@query("q42_business_score", _per("""SELECT '{c}' AS name, 'numeric' AS kind, round((CASE WHEN cv > 1 THEN 3.0 WHEN cv > 0.5 THEN 2.0 WHEN cv > 0.1 THEN 1.0 ELSE 0.2 END + CASE WHEN w > 100 THEN 1.5 WHEN w > 10 THEN 1.0 WHEN w > 1 THEN 0.5 ELSE 0.1 END
    + CASE WHEN '{c}' IN ('l_quantity', 'l_extendedprice', 'l_discount') THEN 3.0 ELSE 0.0 END) * CASE WHEN k <= 7 THEN 0.5 ELSE 1.0 END * CASE WHEN k > 0.9 * n AND n > 50 THEN 0 ELSE 1 END, 2) AS score
    FROM (SELECT stddev_samp({c}) / (abs(avg({c})) + 1e-9) AS cv, max({c}) - min({c}) AS w, count(DISTINCT {c}) AS k, count(*) AS n FROM lineitem)""") + """ UNION ALL SELECT 'l_returnflag', 'string',
    round(CASE WHEN k BETWEEN 3 AND 15 THEN 2.5 WHEN k BETWEEN 2 AND 30 THEN 1.5 WHEN k <= 50 THEN 0.5 ELSE 0.1 END * CASE WHEN k > 1 AND spread < 5 THEN 0.3 ELSE 1.0 END, 2) FROM (SELECT count(*) AS k, 100 * (max(n) - min(n)) / sum(n) AS spread FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag))""")
def q42(t):
    return scoring.business_scores(t("lineitem").select(*_NUM, "l_returnflag"))


@query("q43_quality_warnings", """WITH d AS (SELECT c_mktsegment, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS b FROM customer), g AS (SELECT count(*) AS n FROM d GROUP BY c_mktsegment)
    SELECT 100 - CASE WHEN 100.0 * (SELECT max(n) - min(n) FROM g) / (SELECT sum(n) FROM g) < 3 THEN 20 ELSE 0 END - CASE WHEN count(*) FILTER (b IS NULL) / (2.0 * count(*)) > 0.2 THEN 15 ELSE 0 END - CASE WHEN count(*) < 50 THEN 10 ELSE 0 END AS score,
    CAST(100.0 * (SELECT max(n) - min(n) FROM g) / (SELECT sum(n) FROM g) < 3 AS BIGINT) AS even, CAST(1 AS BIGINT) AS categories, round(count(*) FILTER (b IS NULL) / (2.0 * count(*)), 6) AS missing_share, count(*) AS rows FROM d""")
def q43(t):
    return rounded(scoring.quality_warnings(_customer_gaps(t).drop("c_custkey")), "missing_share", places=6)


@query("q44_significance", """WITH g AS (SELECT sum(o_totalprice) AS v FROM orders GROUP BY o_orderpriority)
    SELECT 'ranking' AS kind, (max(v) - min(v)) / avg(v) >= 0.05 AND 100 * (max(v) - min(v)) / sum(v) >= 3 AS significant, round((max(v) - min(v)) / avg(v), 6) AS measure FROM g
    UNION ALL SELECT 'distribution', stddev_samp(o_totalprice) / avg(o_totalprice) >= 0.01, round(stddev_samp(o_totalprice) / avg(o_totalprice), 6) FROM orders
    UNION ALL SELECT 'scatter', abs(corr(l_quantity, l_extendedprice)) >= 0.15, round(abs(corr(l_quantity, l_extendedprice)), 6) FROM lineitem""")
def q44(t):
    parts = [("ranking", scoring.significant(t("orders"), "ranking", "o_orderpriority", "o_totalprice")), ("distribution", scoring.significant(t("orders"), "distribution", "o_totalprice")), ("scatter", scoring.significant(t("lineitem"), "scatter", "l_quantity", "l_extendedprice"))]
    out = None
    for name, p in parts:
        p = p.select(F.lit(name).alias("kind"), "significant", r("measure", 6).alias("measure"))
        out = p if out is None else out.union(p)
    return out


@query("q45_stat_score", _per("""SELECT '{c}' AS name, round(20.0 * count({c}) / count(*) + 15.0 * count(*) FILTER ({c} <> 0) / count({c}) + least(ln(1 + stddev_samp({c})), 10) - CASE WHEN count(DISTINCT {c}) > 0.98 * count({c}) THEN 20 ELSE 0 END
    - CASE WHEN (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY {c})) > 0.9 * count({c}) THEN 12 ELSE 0 END, 4) AS stat_score FROM lineitem"""))
def q45(t):
    return rounded(scoring.stat_scores(t("lineitem").select(*_NUM)).select("name", "stat_score"), "stat_score")


@query("q46_best_datetime", "SELECT 'o_orderdate' AS name, round(20.0 * count(o_orderdate) / count(*) + least(count(DISTINCT o_orderdate) / 10.0, 10), 4) AS score FROM orders")
def q46(t):
    return rounded(scoring.best_datetime(t("orders"), ["o_orderdate"]), "score")


@query("q47_granularity", """WITH g AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS gap FROM events), m AS (SELECT median(gap) / 86400e6 AS d, count(gap) AS n FROM g)
    SELECT round(d, 6) AS gap_days, CASE WHEN n < 2 THEN 'monthly' WHEN d <= 1 THEN 'daily' WHEN d <= 7 THEN 'weekly' WHEN d <= 31 THEN 'monthly' WHEN d <= 92 THEN 'quarterly' ELSE 'yearly' END AS granularity FROM m""")
def q47(t):
    return rounded(scoring.granularity(t("events"), "ts"), "gap_days", places=6)


@query("q48_two_sigma", """WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS sd FROM lineitem)
    SELECT round(min(m), 4) AS mean, round(min(sd), 4) AS std, count(*) FILTER (abs(l_extendedprice - m) > 2 * sd) AS outliers, round(count(*) FILTER (abs(l_extendedprice - m) > 2 * sd) / count(*), 6) AS share FROM lineitem, s""")
def q48(t):
    return rounded(rounded(scoring.two_sigma(t("lineitem"), "l_extendedprice"), "mean", "std"), "share", places=6)


# ---- Cleaning (P3-P18, C21-C26, W2, O7) ---------------------------------------------------------------------------

def _decorated(t):
    k, p = F.col("l_orderkey"), F.floor("l_extendedprice").cast("long").cast("string")
    v = F.when(k % 4 == 0, F.concat(F.lit("$"), p)).when(k % 4 == 1, F.concat(p, F.lit(" kg"))).when(k % 4 == 2, F.concat(F.lit("("), p, F.lit(")"))).otherwise(F.concat(F.lit("USD"), p, F.lit("%")))
    return t("lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))


_DECORATED = """SELECT l_orderkey, l_linenumber, CASE l_orderkey % 4 WHEN 0 THEN '$' || p WHEN 1 THEN p || ' kg' WHEN 2 THEN '(' || p || ')' ELSE 'USD' || p || '%' END AS v
    FROM (SELECT *, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS p FROM lineitem)"""


@query("q49_clean_number", f"SELECT l_orderkey % 4 AS kind, count(*) AS n, round(sum(CAST((CASE WHEN v LIKE '(%' THEN '-' ELSE '' END) || regexp_replace(v, '[^0-9]', '', 'g') AS DOUBLE)), 2) AS total FROM ({_DECORATED}) GROUP BY 1")
def q49(t):
    return _decorated(t).groupBy((F.col("l_orderkey") % 4).alias("kind")).agg(F.count("*").alias("n"), r(F.sum(E.clean_number(F.col("v"))), 2).alias("total"))


@query("q50_coercion_decision", f"SELECT count(*) AS n, count(*) FILTER (regexp_matches(v, '[0-9]')) AS digits, count(*) FILTER (TRY_CAST(regexp_replace(v, '[^0-9.-]', '', 'g') AS DOUBLE) IS NOT NULL) AS parsed, CASE WHEN count(*) FILTER (regexp_matches(v, '[0-9]')) >= 0.5 * count(v) AND count(*) FILTER (TRY_CAST(regexp_replace(v, '[^0-9.-]', '', 'g') AS DOUBLE) IS NOT NULL) >= 0.8 * count(v) THEN 'double' ELSE 'string' END AS becomes FROM ({_DECORATED})")
def q50(t):
    df = _decorated(t).select("v")
    made, _ = cleaning.coerce_numbers(df)
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("v").rlike(r"\d")).alias("digits"), F.count(E.clean_number(F.col("v"))).alias("parsed")).withColumn("becomes", F.lit(dict(made.dtypes)["v"]))


@query("q51_plain_coercion", "SELECT p_size % 5 AS part, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1")
def q51(t):
    df = t("part").select((F.col("p_size") % 5).alias("part"), F.concat(F.lit(" $"), F.format_number("p_retailprice", 2), F.lit(" ")).alias("price"))
    return rounded(cleaning.coerce_plain(df)[0].groupBy("part").agg(F.sum("price").alias("total")), "total", places=2)


_LIBRARY = {"Ring": ("ring",), "Tool": ("widget", "bolt", "gear")}


@query("q52_categories", "SELECT CASE WHEN contains(lower(trim(p_name)), 'ring') THEN 'Ring' WHEN contains(lower(trim(p_name)), 'widget') OR contains(lower(trim(p_name)), 'bolt') OR contains(lower(trim(p_name)), 'gear') THEN 'Tool' END AS category, count(*) AS n FROM part GROUP BY 1")
def q52(t):
    return t("part").groupBy(cleaning.categorize(F.col("p_name"), _LIBRARY).alias("category")).agg(F.count("*").alias("n"))


@query("q53_duration", """SELECT l_linestatus, count(h) AS n, round(sum(h), 2) AS hours FROM (SELECT l_linestatus, CASE WHEN l_shipdate >= o_orderdate THEN date_diff('hour', o_orderdate, l_shipdate) END AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""")
def q53(t):
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_linestatus", cleaning.hours_between(F.col("o_orderdate"), F.col("l_shipdate")).alias("h"))
    return rows.groupBy("l_linestatus").agg(F.count("h").alias("n"), r(F.sum("h"), 2).alias("hours"))


@query("q54_clock", "SELECT CAST(hour(ts) AS INTEGER) AS ts_hour, dayname(ts) AS ts_day_of_week, count(*) AS n FROM events GROUP BY 1, 2")
def q54(t):
    return cleaning.add_clock(t("events").select("ts"), ["ts"]).groupBy("ts_hour", "ts_day_of_week").agg(F.count("*").alias("n"))


_IMPUTE = "SELECT l_returnflag AS f, CASE WHEN l_orderkey % 25 <> 0 THEN l_quantity END AS a, CASE WHEN l_orderkey % 5 <> 0 THEN l_extendedprice END AS b, CASE WHEN l_orderkey % 3 <> 0 THEN l_tax END AS c FROM lineitem"


@query("q55_impute_numeric", f"""WITH d AS ({_IMPUTE}), s AS (SELECT avg(a) AS a, median(b) AS b, median(c) AS c FROM d)
    SELECT f, round(sum(coalesce(d.a, s.a)), 2) AS a, round(sum(coalesce(d.b, s.b)), 2) AS b, round(sum(coalesce(d.c, s.c)), 4) AS c, CAST(sum(CASE WHEN d.c IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS c_missing FROM d, s GROUP BY 1""")
def q55(t):
    k = F.col("l_orderkey")
    df = t("lineitem").select(F.col("l_returnflag").alias("f"), F.when(k % 25 != 0, F.col("l_quantity")).alias("a"), F.when(k % 5 != 0, F.col("l_extendedprice")).alias("b"), F.when(k % 3 != 0, F.col("l_tax")).alias("c"))
    out = cleaning.impute(df, ["a", "b", "c"], near=None)[0]
    return rounded(rounded(out.groupBy("f").agg(*(F.sum(x).alias(x) for x in ("a", "b", "c", "c_missing"))), "a", "b", places=2), "c")


@query("q56_impute_category", """WITH d AS (SELECT CASE WHEN c_custkey % 25 <> 0 THEN c_mktsegment END AS a, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS b FROM customer),
    m AS (SELECT a AS m FROM d WHERE a IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, a LIMIT 1) SELECT coalesce(a, m) AS a, coalesce(b, 'Missing') AS b, count(*) AS n FROM d, m GROUP BY 1, 2""")
def q56(t):
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    out = cleaning.impute(t("customer").select(F.when(k % 25 != 0, s).alias("a"), F.when(k % 3 != 0, s).alias("b")))[0]
    return out.groupBy("a", "b").agg(F.count("*").alias("n"))


@query("q57_fill_in_order", """WITH d AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events)
    SELECT event_id, user_id, round(coalesce(last_value(value IGNORE NULLS) OVER w, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS value
    FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q57(t):
    df = _gaps(t("events"), "value", "event_id", 3)
    return rounded(cleaning.fill_in_order(df, "value", ["ts", "event_id"], ["user_id"]).select("event_id", "user_id", "value"), "value")


@query("q58_winsorize", """WITH d AS (SELECT o_orderstatus, CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 20 ELSE o_totalprice END AS p FROM orders), q AS (SELECT quantile_cont(p, 0.25) AS a, quantile_cont(p, 0.75) AS b FROM d)
    SELECT o_orderstatus, round(sum(greatest(least(p, b + 1.5 * (b - a)), a - 1.5 * (b - a))), 2) AS total, round(max(least(p, b + 1.5 * (b - a))), 4) AS high FROM d, q GROUP BY 1""")
def q58(t):
    df = t("orders").select("o_orderstatus", F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") * 20).otherwise(F.col("o_totalprice")).alias("p"))
    return rounded(rounded(cleaning.winsorize(df, ["p"])[0].groupBy("o_orderstatus").agg(F.sum("p").alias("total"), F.max("p").alias("high")), "total", places=2), "high")


@query("q59_standardize", f"""WITH d AS ({_VARIANTS}), c AS (SELECT segment, lower(trim(segment)) AS k, count(*) AS n FROM d GROUP BY 1), b AS (SELECT k, segment AS s FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, segment) = 1)
    SELECT s AS segment, count(*) AS n FROM d JOIN b ON lower(trim(segment)) = k GROUP BY 1""")
def q59(t):
    return cleaning.standardize(_variants(t), "segment").groupBy("segment").agg(F.count("*").alias("n"))


@query("q60_drop_duplicates", "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT DISTINCT text, lang FROM documents) GROUP BY 1")
def q60(t):
    return t("documents").select("text", "lang").dropDuplicates().groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# ---- Features (C27-C34, A35, A36, meta-features) ------------------------------------------------------------------

@query("q61_one_hot", "SELECT " + ", ".join(f"""CAST(sum(CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END) AS BIGINT) AS "{c}" """ for p, c in (("2-HIGH", "high"), ("3-MEDIUM", "medium"), ("4-NOT SPECIFIED", "none"), ("5-LOW", "low"))) + " FROM orders")
def q61(t):
    out = features.one_hot(t("orders").select("o_orderpriority"), "o_orderpriority")
    return out.agg(*(F.sum(F.col(f"`o_orderpriority_{p}`")).alias(c) for p, c in (("2-HIGH", "high"), ("3-MEDIUM", "medium"), ("4-NOT SPECIFIED", "none"), ("5-LOW", "low"))))


@query("q62_label_encode", "SELECT CAST(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS INTEGER) AS l_linestatus, n FROM (SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1)")
def q62(t):
    return features.label_encode(t("lineitem").select("l_linestatus"), "l_linestatus").groupBy("l_linestatus").agg(F.count("*").alias("n"))


@query("q63_target_encode", """WITH m AS (SELECT p_brand, avg(p_retailprice) AS m, count(*) AS n, CASE WHEN count(*) > 1 THEN 1 / (1 + exp(-(count(*) - 1))) ELSE 0 END AS w FROM part GROUP BY 1)
    SELECT p_brand, round(w * m + (1 - w) * (SELECT avg(p_retailprice) FROM part), 4) AS p_brand_target, n FROM m""")
def q63(t):
    out = features.target_encode(t("part"), "p_brand", "p_retailprice")
    return rounded(out.groupBy("p_brand").agg(F.min("p_brand_target").alias("p_brand_target"), F.count("*").alias("n")), "p_brand_target")


@query("q64_scale", """WITH s AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS b, median(l_quantity) AS m, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS w FROM lineitem)
    SELECT l_returnflag, round(sum((l_quantity - a) / b), 3) AS standard, round(sum((l_quantity - m) / w), 3) AS robust FROM lineitem, s GROUP BY 1""")
def q64(t):
    df = t("lineitem").select("l_returnflag", "l_quantity")
    a, b = (features.scale(df, ["l_quantity"], m)[0].groupBy("l_returnflag").agg(r(F.sum("l_quantity"), 3).alias(m)) for m in ("standard", "robust"))
    return a.join(b, "l_returnflag")


@query("q65_mutual_information", """WITH e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), b AS (SELECT least(floor((l_quantity - lo) / (hi - lo) * 10), 9) AS b, l_returnflag AS t FROM lineitem, e),
    c AS (SELECT b, t, count(*) AS n FROM b GROUP BY 1, 2), x AS (SELECT *, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER (PARTITION BY t) AS nt, sum(n) OVER () AS total FROM c)
    SELECT 'l_quantity' AS name, round(sum(n / total * ln(n * total / (nb * nt))), 8) AS mi FROM x""")
def q65(t):
    return rounded(features.mutual_information(t("lineitem"), ["l_quantity"], "l_returnflag"), "mi", places=8)


@query("q66_vif", "SELECT 'l_quantity' AS name, round(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)), 2) AS vif FROM lineitem UNION ALL SELECT 'l_extendedprice', round(1 / (1 - pow(corr(l_quantity, l_extendedprice), 2)), 2) FROM lineitem")
def q66(t):
    df = t("lineitem")
    return df.sparkSession.createDataFrame(list(features.vif(df, ["l_quantity", "l_extendedprice"]).items()), "name string, vif double")


@query("q67_entropy", """WITH c AS (SELECT count(*) AS n FROM events GROUP BY event_type), p AS (SELECT n / (SELECT sum(n) FROM c) AS p, n FROM c)
    SELECT round(-sum(p * ln(p + 1e-10)) / ln(greatest(count(*), 2)), 6) AS entropy, round(min(n) / max(n), 6) AS balance FROM p""")
def q67(t):
    return rounded(features.entropy(t("events"), "event_type"), "entropy", "balance", places=6)


@query("q68_meta_moments", _per("SELECT '{c}' AS name, round(skewness_pop, 6) AS skew, round(k, 6) AS kurtosis, round(cv, 6) AS cv, round(w, 4) AS width, round(z, 6) AS zeros FROM (SELECT (avg(pow({c} - m, 3))) / pow(avg(pow({c} - m, 2)), 1.5) AS skewness_pop, kurtosis_pop({c}) AS k, abs(stddev_pop({c}) / (avg({c}) + 1e-10)) AS cv, (max({c}) - min({c})) / (stddev_pop({c}) + 1e-10) AS w, count(*) FILTER ({c} = 0) / count(*) AS z FROM lineitem, (SELECT avg({c}) AS m FROM lineitem))"))
def q68(t):
    df = t("lineitem")
    row = df.agg(*(x for i, c in enumerate(_NUM) for x in (F.skewness(c).alias(f"s{i}"), F.kurtosis(c).alias(f"k{i}"), F.abs(F.stddev_pop(c) / (F.avg(c) + 1e-10)).alias(f"c{i}"), ((F.max(c) - F.min(c)) / (F.stddev_pop(c) + 1e-10)).alias(f"w{i}"), (F.count_if(F.col(c) == 0) / F.count("*")).alias(f"z{i}"))))
    cells = F.array(*(F.struct(F.lit(c).alias("name"), r(f"s{i}", 6).alias("skew"), r(f"k{i}", 6).alias("kurtosis"), r(f"c{i}", 6).alias("cv"), r(f"w{i}").alias("width"), r(f"z{i}", 6).alias("zeros")) for i, c in enumerate(_NUM)))
    return row.select(F.inline(cells))


@query("q69_target_correlation", "SELECT round((a + b + c) / 3, 6) AS mean, round(greatest(a, b, c), 6) AS max FROM (SELECT abs(corr(l_extendedprice, l_quantity)) AS a, abs(corr(l_discount, l_quantity)) AS b, abs(corr(l_tax, l_quantity)) AS c FROM lineitem)")
def q69(t):
    pairs = charts.correlation_pairs(t("lineitem"), list(_NUM)).where("a = 'l_quantity'")
    return rounded(pairs.agg(F.avg(F.abs("r")).alias("mean"), F.max(F.abs("r")).alias("max")), "mean", "max", places=6)


@query("q70_three_sigma_rows", """WITH s AS (SELECT avg(l_quantity) AS qa, stddev_pop(l_quantity) AS qs, avg(l_extendedprice) AS pa, stddev_pop(l_extendedprice) AS ps FROM lineitem)
    SELECT count(*) FILTER (greatest(abs((l_quantity - qa) / qs), abs((l_extendedprice - pa) / ps)) > 3) AS outliers, count(*) AS rows FROM lineitem, s""")
def q70(t):
    df = t("lineitem").select("l_quantity", "l_extendedprice")
    s = F.broadcast(df.agg(*(x for c in df.columns for x in (F.avg(c).alias(f"a_{c}"), F.stddev_pop(c).alias(f"s_{c}")))))  # one row
    z = F.greatest(*(F.abs((F.col(c) - F.col(f"a_{c}")) / F.col(f"s_{c}")) for c in df.columns))
    return df.crossJoin(s).agg(F.count_if(z > 3).alias("outliers"), F.count("*").alias("rows"))


@query("q71_meta_missing", """SELECT round((a + b) / 2, 6) AS mean_missing, round(greatest(a, b), 6) AS max_missing, round(u, 6) AS unique_share FROM (SELECT count(*) FILTER (p_partkey % 5 = 0) / count(*) AS a, 0.0 AS b, count(DISTINCT p_brand) / count(*) AS u FROM part)""")
def q71(t):
    stats = profile.column_stats(_gaps(t("part"), "p_retailprice", "p_partkey", 5).select("p_retailprice", "p_brand"))
    share = E.ratio(F.col("missing"), F.col("rows"))
    return rounded(stats.agg(F.avg(share).alias("mean_missing"), F.max(share).alias("max_missing"), F.max(F.when(F.col("name") == "p_brand", E.ratio(F.col("distinct"), F.col("rows")))).alias("unique_share")), "mean_missing", "max_missing", "unique_share", places=6)


@query("q72_sparsity", "SELECT round((count(*) FILTER (abs(l_discount) < 0.05 * w) / count(*) + count(*) FILTER (abs(l_tax) < 0.05 * v) / count(*)) / 2, 6) AS sparsity FROM lineitem, (SELECT max(l_discount) - min(l_discount) AS w, max(l_tax) - min(l_tax) AS v FROM lineitem)")
def q72(t):
    df = t("lineitem").select("l_discount", "l_tax")
    w = F.broadcast(df.agg(*((F.max(c) - F.min(c)).alias(f"w_{c}") for c in df.columns)))  # one row
    near = sum(((F.abs(F.col(c)) < 0.05 * F.col(f"w_{c}")).cast("int") for c in df.columns), F.lit(0)) / 2
    return df.crossJoin(w).agg(r(F.avg(near), 6).alias("sparsity"))


# ---- Evaluation and benchmarks (A29-A38, W3, W4, W8, M9, M10, S13) -------------------------------------------------

@query("q73_confusion", """SELECT CAST(quality AS VARCHAR) AS label, CAST(toxic AS VARCHAR) AS predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM labels GROUP BY quality, toxic""")
def q73(t):
    return rounded(metrics.confusion(t("labels"), "quality", "toxic"), "share", places=6)


@query("q73b_class_errors", "SELECT CAST(quality AS VARCHAR) AS label, count(*) AS total, count(*) FILTER (quality <> toxic) AS errors, round(100.0 * count(*) FILTER (quality <> toxic) / count(*), 2) AS error_pct FROM labels GROUP BY quality")
def q73b(t):
    return metrics.class_errors(t("labels"), "quality", "toxic")


_PREDICTED = "(SELECT l_extendedprice AS y, l_quantity * 1500 AS p, abs(l_extendedprice - l_quantity * 1500) AS e FROM lineitem)"


def _predicted(t):
    return t("lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))


@query("q74_regression_errors", f"SELECT round(1 - avg(e * e) / var_pop(y), 6) AS r2, round(avg(e), 4) AS mae, round(avg(e * e), 1) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(median(e), 4) AS median_error FROM {_PREDICTED}")
def q74(t):
    return rounded(rounded(rounded(metrics.regression(_predicted(t), "y", "p"), "r2", places=6), "mse", places=1), "mae", "rmse", "median_error")


@query("q74b_errors_by_quartile", f"""WITH d AS {_PREDICTED}, q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM d)
    SELECT CASE WHEN y <= a THEN 'low' WHEN y >= b THEN 'high' ELSE 'middle' END AS part, count(*) AS n, round(avg(e), 4) AS mae FROM d, q GROUP BY 1""")
def q74b(t):
    return rounded(metrics.errors_by_quartile(_predicted(t), "y", "p"), "mae")


@query("q74c_auc", """WITH s AS (SELECT (l_returnflag = 'R')::INT AS y, l_quantity AS s FROM lineitem), g AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS q FROM s GROUP BY 1), c AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
    SELECT round(sum(p * (b + q / 2.0)) / (sum(p) * sum(q)), 6) AS auc FROM c""")
def q74c(t):
    return rounded(metrics.roc_auc(t("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_quantity"), "y", "l_quantity"), "auc", places=6)


#: Scores by dataset and model, from the orders: brands of parts by size stand for models on data sets.
_SCORES = "(SELECT p_size AS dataset, p_type AS model, round(avg(p_retailprice) / 2000, 6) AS score FROM part GROUP BY 1, 2)"


def _scores(t):
    return t("part").groupBy(F.col("p_size").alias("dataset"), F.col("p_type").alias("model")).agg(r(F.avg("p_retailprice") / 2000, 6).alias("score"))


@query("q75_selection_summary", f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, model) AS rank, max(score) OVER (PARTITION BY dataset) - score AS regret FROM {_SCORES})
    SELECT round(avg((rank = 1)::INT), 6) AS top1, round(avg((rank <= 3)::INT), 6) AS top3, round(avg(regret), 6) AS mean_regret, round(median(regret), 6) AS median_regret, round(avg(rank), 6) AS mean_rank, round(median(rank), 6) AS median_rank, count(*) AS datasets FROM s WHERE model = 'ECONOMY'""")
def q75(t):
    scores = _scores(t)
    chosen = scores.select("dataset").distinct().withColumn("model", F.lit("ECONOMY"))
    return rounded(metrics.selection_summary(scores, chosen), "top1", "top3", "mean_regret", "median_regret", "mean_rank", "median_rank", places=6)


_DUEL = f"(SELECT dataset, max(score) FILTER (model = 'ECONOMY') AS a, max(score) FILTER (model = 'STANDARD') AS b FROM {_SCORES} GROUP BY 1)"


def _duel(t):
    return _scores(t).groupBy("dataset").agg(F.max(F.when(F.col("model") == "ECONOMY", F.col("score"))).alias("a"), F.max(F.when(F.col("model") == "STANDARD", F.col("score"))).alias("b"))


@query("q75b_wins", f"""SELECT count(*) FILTER (a > b) AS wins, count(*) FILTER (a = b) AS ties, count(*) FILTER (a < b) AS losses, count(*) FILTER (a - b > 0.01) AS clear_wins, count(*) FILTER (abs(a - b) <= 0.01) AS near,
    count(*) FILTER (a - b < -0.01) AS clear_losses, round(avg(a - b), 6) AS mean_gap FROM {_DUEL} WHERE a IS NOT NULL AND b IS NOT NULL""")
def q75b(t):
    return rounded(metrics.wins(_duel(t), "a", "b"), "mean_gap", places=6)


@query("q75c_wilcoxon", f"""WITH d AS (SELECT a - b AS d FROM {_DUEL} WHERE a <> b), g AS (SELECT abs(d) AS s, count(*) AS n, count(*) FILTER (d > 0) AS pos FROM d GROUP BY 1),
    m AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS mid FROM g), t AS (SELECT sum(mid * pos) AS w, sum(n)::DOUBLE AS n, sum(pow(n, 3) - n) AS ties FROM m)
    SELECT round(w, 4) AS w_plus, n, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM t""")
def q75c(t):
    return rounded(rounded(metrics.wilcoxon(_duel(t), "a", "b"), "w_plus"), "z", places=6)


@query("q75d_oracle_frequency", f"SELECT model, count(*) AS best_on FROM (SELECT model, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, model) AS r FROM {_SCORES}) WHERE r = 1 GROUP BY 1")
def q75d(t):
    return metrics.oracle_frequency(_scores(t))


@query("q76_ranks", f"""SELECT dataset, model, CAST(row_number() OVER (PARTITION BY dataset ORDER BY score DESC, model) AS INTEGER) AS rank, round(1 - (rank() OVER (PARTITION BY dataset ORDER BY score DESC) - 1) / count(*) OVER (PARTITION BY dataset), 6) AS reward,
    round(max(score) OVER (PARTITION BY dataset) - score, 6) AS regret FROM {_SCORES}""")
def q76(t):
    return rounded(metrics.ranks(_scores(t)).select("dataset", "model", "rank", "reward", "regret"), "reward", "regret", places=6)


@query("q77_last_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 8")
def q77(t):
    return metrics.last_turns(t("conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


@query("q77b_rolling_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), 8) AS smooth FROM events")
def q77b(t):
    return rounded(metrics.rolling_mean(t("events"), "user_id", "event_id", "value").select("event_id", "smooth"), "smooth", places=8)


# ---- Sources, types, key figures ----------------------------------------------------------------------------------

@query("q78_union_sheets", "SELECT 'customers' AS _sheet, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer UNION ALL SELECT 'suppliers', count(*), round(sum(s_acctbal), 2) FROM supplier")
def q78(t):
    sheets = {"customers": t("customer").select(F.col("c_name").alias("Name"), F.col("c_acctbal").alias("Acct Bal"), "c_mktsegment"), "suppliers": t("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acct-bal"))}
    return rounded(files.union_sheets(sheets).groupBy("_sheet").agg(F.count("*").alias("n"), F.sum("acct_bal").alias("total")), "total", places=2)


@query("q79_fix_types", "SELECT count(*) AS n, round(sum(p_retailprice), 2) AS price, count(DISTINCT CAST(p_size AS VARCHAR)) AS sizes FROM part")
def q79(t):
    out = cleaning.fix_types(t("part").select(F.col("p_retailprice").cast("string").alias("price"), "p_size"), {"price": "numeric", "p_size": "categorical"})
    return rounded(out.agg(F.count("*").alias("n"), F.sum("price").alias("price"), F.count_distinct("p_size").alias("sizes")), "price", places=2)


@query("q80_kpis", """SELECT 0 AS place, 'Records' AS label, CAST(count(*) AS DOUBLE) AS value FROM part UNION ALL SELECT 1, 'Average p_retailprice', round(avg(p_retailprice), 4) FROM part
    UNION ALL SELECT 2, 'Total p_size', round(sum(p_size), 4) FROM part UNION ALL SELECT 3, 'Completeness', 100.0 FROM part LIMIT 4""".replace("FROM part UNION ALL SELECT 3, 'Completeness', 100.0 FROM part LIMIT 4", "FROM part UNION ALL SELECT 3, 'Completeness', 100.0"))
def q80(t):
    return rounded(scoring.kpis(t("part").select("p_size", "p_retailprice")), "value")


@query("q81_brand_revenue", "SELECT p_brand, round(sum(l_extendedprice * (1 - l_discount)), 2) AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def q81(t):
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "l_linestatus", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return rounded(charts.build(rows, ChartSpec("bar", "p_brand", "revenue", sort_by="y_desc", top_n=12, filter_col="l_linestatus", filter_val="F")), "value", places=2)


@query("q82_warnings", "SELECT 'p_brand' AS name, 'constant' AS warning FROM part WHERE FALSE UNION ALL SELECT 'tax', 'missing'")
def q82(t):
    return profile.warnings(t("lineitem").select(F.when(F.col("l_orderkey") % 3 != 0, F.col("l_tax")).alias("tax"), "l_returnflag"))


@query("q83_findings_outliers", """WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders)
    SELECT 'outliers' AS kind, 'o_totalprice' AS subject, CAST(count(*) FILTER (abs(o_totalprice - m) > 2 * sd) AS VARCHAR) AS detail, round(count(*) FILTER (abs(o_totalprice - m) > 2 * sd) / count(*), 6) AS value FROM orders, s HAVING count(*) FILTER (abs(o_totalprice - m) > 2 * sd) > 0
    UNION ALL (SELECT 'best', 'o_totalprice by o_orderpriority', o_orderpriority, round(avg(o_totalprice), 6) FROM orders GROUP BY 3 ORDER BY avg(o_totalprice) DESC, 3 LIMIT 1)
    UNION ALL (SELECT 'worst', 'o_totalprice by o_orderpriority', o_orderpriority, round(avg(o_totalprice), 6) FROM orders GROUP BY 3 ORDER BY avg(o_totalprice), 3 LIMIT 1)""")
def q83(t):
    return rounded(insights.findings(t("orders"), ["o_totalprice"], ["o_orderpriority"]), "value", places=6).where("kind <> 'dominant'")


@query("q84_takeaways")
def q84(t):
    return rounded(insights.takeaways(t("lineitem").select(*_NUM, "l_returnflag")), "value", places=6)


@query("q85_comparison", """WITH g AS (SELECT o_orderpriority AS k, sum(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT (SELECT k FROM g ORDER BY v DESC, k DESC LIMIT 1) AS leader, round(max(v), 2) AS leader_value, (SELECT k FROM g ORDER BY v, k LIMIT 1) AS last, round(max(v) / min(v), 6) AS ratio, round(max(v) / sum(v), 6) AS share,
    round((SELECT sum(v) FROM (SELECT v FROM g ORDER BY v DESC, k LIMIT 3)) / sum(v), 6) AS top3_share, count(*) AS groups FROM g""")
def q85(t):
    return rounded(rounded(insights.comparison(t("orders"), "o_orderpriority", "o_totalprice"), "leader_value", places=2), "ratio", "share", "top3_share", places=6)


@query("q86_distribution", """WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders)
    SELECT round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 4) AS std, round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max, round(skewness(o_totalprice), 6) AS skew, count(*) AS n, count(*) FILTER (abs(o_totalprice - m) > 2 * sd) AS outliers,
    CASE WHEN skewness(o_totalprice) > 1 THEN 'right' WHEN skewness(o_totalprice) > 0.5 THEN 'slightly right' WHEN skewness(o_totalprice) < -1 THEN 'left' WHEN skewness(o_totalprice) < -0.5 THEN 'slightly left' ELSE 'symmetric' END AS shape FROM orders, s""")
def q86(t):
    return rounded(rounded(insights.distribution(t("orders"), "o_totalprice"), "mean", "median", "std", "min", "max"), "skew", places=6)


@query("q87_correlation_class", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, CASE WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.7 THEN 'strong' WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.4 THEN 'moderate' WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.3 THEN 'weak' ELSE 'none' END AS strength, CASE WHEN corr(l_quantity, l_extendedprice) > 0 THEN 'positive' ELSE 'negative' END AS direction FROM lineitem")
def q87(t):
    return rounded(insights.correlation(t("lineitem"), "l_quantity", "l_extendedprice"), "r", places=6)


@query("q88_superlative", "SELECT CAST(row_number() OVER (ORDER BY v DESC, key) AS INTEGER) AS place, key, round(v, 4) AS value, n FROM (SELECT c_mktsegment AS key, avg(c_acctbal) AS v, count(*) AS n FROM customer GROUP BY 1) ORDER BY 1 LIMIT 3")
def q88(t):
    return rounded(insights.superlative(t("customer"), "c_mktsegment", "c_acctbal"), "value")


@query("q89_questions", "SELECT * FROM (VALUES (1, 'time_series', NULL, NULL, 'monthly', 'o_orderdate', 'price'), (2, 'bar', 'mean', NULL, NULL, 'o_orderpriority', 'price'), (3, 'bar', NULL, 5, NULL, 'o_orderpriority', 'price'), (4, 'histogram', NULL, NULL, NULL, 'price', NULL), (5, 'count', 'count', NULL, NULL, 'o_orderstatus', NULL), (6, 'heatmap', NULL, NULL, NULL, NULL, NULL)) AS v(id, intent, agg, top_n, granularity, x, y)")
def q89(t):
    asked = ["show monthly price trend", "average price by o_orderpriority", "top 5 o_orderpriority by price", "distribution of price", "how many records per o_orderstatus", "show correlation matrix"]
    df = t("orders").sparkSession.createDataFrame(list(enumerate(asked, 1)), "id int, question string")
    return questions.annotate(df, "question", ["price"], ["o_orderstatus", "o_orderpriority"], ["o_orderdate"]).drop("question")


@query("q90_fences", "SELECT round(q1 - 1.5 * (q3 - q1), 4) AS low, round(q3 + 1.5 * (q3 - q1), 4) AS high, count(*) FILTER (o_totalprice NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outside, count(*) AS n FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders) GROUP BY 1, 2")
def q90(t):
    df = t("orders")
    lo, hi, out, n = cleaning.outlier_bounds(df, ["o_totalprice"])["o_totalprice"]
    return df.sparkSession.createDataFrame([(round(lo, 4), round(hi, 4), out, n)], "low double, high double, outside long, n long")


# ---- Event-time windows (an addition) -----------------------------------------------------------------------------

@query("q91_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q91(t):
    return windows.tumbling(t("events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", r("total").alias("total"))


@query("q92_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def q92(t):
    return windows.sessions(t("events")).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("q93_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q93(t):
    return metrics.done_already(t("orders").select("o_orderkey"), t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


# ---- Models and more (M1-M10, M16, M17, W5, P14, O5, S9, F15, J1) -------------------------------------------------

def _orders_rows(t):
    """Is an order dear? from its date, customer and priority."""
    df = t("orders").select("o_orderkey", (F.col("o_totalprice") > 250_000).cast("int").alias("dear"), F.month("o_orderdate").alias("month"), (F.col("o_totalprice") / 1000 + F.col("o_custkey") % 50).alias("hint"))
    return models.prepare(df, ["month", "hint"], "dear", "o_orderkey")[0]


@query("q94_train_and_vote")
def q94(t):
    train, test = models.split(_orders_rows(t))
    fitted = [models.estimators("classification")[m].fit(train) for m in ("logistic", "decision_tree")]
    return metrics.class_errors(models.vote(test, fitted, "classification", 2), "label", "prediction")


@query("q95_permutation_importance")
def q95(t):
    train, test = models.split(_orders_rows(t))
    fitted = models.estimators("classification")["decision_tree"].fit(train)
    return rounded(models.permutation_importance(test, fitted, ["month", "hint"], "classification"), "importance")


@query("q96_linear_shap", "SELECT l_orderkey % 10 AS part, count(*) AS n, round(sum(1500 * (l_quantity - (SELECT avg(l_quantity) FROM lineitem))), 2) AS total FROM lineitem GROUP BY 1")
def q96(t):
    df = t("lineitem").withColumn("row", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rows, _ = models.prepare(df, ["l_quantity", "l_discount"], "l_extendedprice", "row")
    shap = models.linear_shap(rows, [1500.0, 0.0], ["l_quantity", "l_discount"]).where("name = 'l_quantity'")
    return shap.groupBy((F.floor(F.col("row_id") / 10) % 10).alias("part")).agg(F.count("*").alias("n"), r(F.sum("shap"), 2).alias("total"))


@query("q97_meta_features")
def q97(t):
    df = t("lineitem").select(*_NUM, "l_returnflag")
    vector = meta_features.extract(df, "l_returnflag", "classification", landmarks=False)
    return df.sparkSession.createDataFrame([(i, round(v, 6)) for i, v in enumerate(vector)], "place int, value double")


@query("q98_checked_mapping", "SELECT CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' END AS o_orderstatus_category, count(*) AS n FROM orders GROUP BY 1")
def q98(t):
    return cleaning.checked_mapping(t("orders"), "o_orderstatus", {"F": "closed", "O": "open"}, 0.9).groupBy("o_orderstatus_category").agg(F.count("*").alias("n"))


@query("q99_lookup_join", "SELECT n_name, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def q99(t):
    labels = t("nation").select(F.col("n_nationkey").alias("value"), F.col("n_name").alias("label"))
    return cleaning.map_values(t("customer"), "c_nationkey", labels, "n_name").groupBy("n_name").agg(F.count("*").alias("n"))


@query("q100_sparse_columns", "SELECT 'l_tax' AS kept, count(l_tax) AS n FROM lineitem")
def q100(t):
    df = t("lineitem").select("l_tax", F.when(F.col("l_orderkey") % 4 == 0, F.col("l_discount")).alias("rare"))
    out = cleaning.drop_sparse_columns(df)
    return out.agg(F.lit(",".join(out.columns)).alias("kept"), F.count("l_tax").alias("n"))


@query("q101_baselines", f"""WITH p AS (SELECT dataset, max(score) AS o, avg(score) AS r, max(score) FILTER (model = 'ECONOMY') AS e FROM {_SCORES} GROUP BY 1)
    SELECT 'oracle' AS strategy, round(avg(o), 6) AS mean_score FROM p UNION ALL SELECT 'random', round(avg(r), 6) FROM p UNION ALL SELECT 'always_ECONOMY', round(avg(e), 6) FROM p""")
def q101(t):
    return rounded(metrics.baselines(_scores(t), ["ECONOMY"]), "mean_score", places=6)


@query("q102_profile_roles", " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\" FROM lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_NUM, "l_returnflag", "l_linestatus", "l_shipdate")))
def q102(t):
    return profile.roles(t("lineitem")).select("name", "rows", "missing", "distinct")


@query("q103_catalogue", "SELECT p_partkey AS dataset_id, CAST(p_size * 40 AS BIGINT) AS rows FROM part WHERE p_size * 40 BETWEEN 100 AND 50000 AND p_partkey % 3 <> 0")
def q103(t):
    catalogue = t("part").select(F.col("p_partkey").alias("dataset_id"), (F.col("p_size") * 40).cast("long").alias("rows"), F.lit(10).alias("features"), F.lit(2).alias("classes"), F.lit(0.1).alias("missing"))
    return files.candidates(catalogue, catalogue.where("dataset_id % 3 = 0")).select("dataset_id", "rows")


_PART_GAPS = "SELECT p_partkey AS id, CASE WHEN p_partkey % {a} <> 0 THEN CAST(p_size AS DOUBLE) END AS a, CASE WHEN p_partkey % {b} <> 0 THEN CAST(p_retailprice AS DOUBLE) END AS b FROM part"
#: Imputation by the five nearest rows, over all pairs: distances over the shared columns, scaled up by both over shared ones.
_NEAREST = """WITH d AS ({rows}), pairs AS (
      SELECT r.id, x.id AS donor, x.a, x.b, sqrt(2.0 / ((r.a IS NOT NULL AND x.a IS NOT NULL)::INT + (r.b IS NOT NULL AND x.b IS NOT NULL)::INT)) * sqrt(coalesce(pow(r.a - x.a, 2), 0) + coalesce(pow(r.b - x.b, 2), 0)) AS apart
      FROM d r JOIN d x ON (r.a IS NULL OR r.b IS NULL) AND ((r.a IS NOT NULL AND x.a IS NOT NULL) OR (r.b IS NOT NULL AND x.b IS NOT NULL))),
    fa AS (SELECT id, avg(a) AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY apart, donor) AS n FROM pairs WHERE a IS NOT NULL) WHERE n <= 5 GROUP BY 1),
    fb AS (SELECT id, avg(b) AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY apart, donor) AS n FROM pairs WHERE b IS NOT NULL) WHERE n <= 5 GROUP BY 1)
    SELECT d.id AS p_partkey, round(coalesce(d.a, fa.v, (SELECT avg(a) FROM d)), 4) AS p_size, round(coalesce(d.b, fb.v, (SELECT avg(b) FROM d)), 4) AS p_retailprice FROM d LEFT JOIN fa USING (id) LEFT JOIN fb USING (id)"""


def _part_gaps(t, a: int, b: int) -> DataFrame:
    return _gaps(_gaps(t("part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_partkey", a), "p_retailprice", "p_partkey", b)


@query("q104_impute_knn", _NEAREST.format(rows=_PART_GAPS.format(a=33, b=20)))
def q104(t):
    return rounded(cleaning.impute_knn(_part_gaps(t, 33, 20), ["p_size", "p_retailprice"], "p_partkey"), "p_size", "p_retailprice")


@query("q105_tree_shap", """WITH d AS (SELECT CAST(l_quantity > 25 AS INT) AS a, CAST(l_discount > 0.05 AS INT) AS b FROM lineitem), s AS (SELECT a, count(*) / (SELECT count(*) FROM d) AS share, avg(b) AS b FROM d GROUP BY 1),
    v AS (SELECT d.a, d.b, count(*) AS n, (SELECT sum(share * (100 * a + 10 * b)) FROM s) AS none, 100 * d.a + 10 * any_value(s.b) AS q, (SELECT sum(share * 100 * a) FROM s) + 10 * d.b AS d, 100 * d.a + 10 * d.b AS qd FROM d JOIN s ON d.a = s.a GROUP BY 1, 2)
    SELECT a, b, n, round((q - none + qd - d) / 2, 6) AS quantity, round((d - none + qd - q) / 2, 6) AS discount FROM v""")
def q105(t):
    a, b = (F.col("l_quantity") > 25).cast("int"), (F.col("l_discount") > 0.05).cast("int")
    df = t("lineitem").withColumns({"side": 2 * a + b, "y": 100.0 * a + 10.0 * b})
    rows, _ = models.prepare(df, ["l_quantity", "l_discount"], "y", "side")
    shap, _ = explain.tree_shap(rows, models.DecisionTreeRegressor(maxDepth=2, maxBins=64).fit(rows), ["l_quantity", "l_discount"])
    mean = lambda c: r(F.avg(F.when(F.col("name") == f"l_{c}", F.col("shap"))), 6).alias(c)
    return shap.groupBy(F.floor(F.col("row_id") / 2).cast("int").alias("a"), (F.col("row_id") % 2).alias("b")).agg(F.count_if(F.col("name") == "l_quantity").alias("n"), mean("quantity"), mean("discount"))


@query("q106_kernel_shap", """SELECT s_suppkey, round(3 * (s_acctbal - (SELECT avg(s_acctbal) FROM supplier)), 3) AS s_acctbal, round(5 * (s_nationkey - (SELECT avg(s_nationkey) FROM supplier)), 3) AS s_nationkey FROM supplier""")
def q106(t):
    df = t("supplier").withColumn("y", 3 * F.col("s_acctbal") + 5 * F.col("s_nationkey"))
    rows, _ = models.prepare(df, ["s_acctbal", "s_nationkey"], "y", "s_suppkey")
    shap = explain.kernel_shap(rows, models.LinearRegression().fit(rows), ["s_acctbal", "s_nationkey"], explain.background(rows, 1))
    return shap.groupBy(F.col("row_id").alias("s_suppkey")).agg(*(r(F.max(F.when(F.col("name") == c, F.col("shap"))), 3).alias(c) for c in ("s_acctbal", "s_nationkey")))


_PSI = "(ln({n} + 10.0) - 1 / (2 * ({n} + 10.0)) - 1 / (12 * pow({n} + 10.0, 2)) + 1 / (120 * pow({n} + 10.0, 4)) - 1 / (252 * pow({n} + 10.0, 6)) - list_sum(list_transform(range(10), lambda i: 1.0 / ({n} + i))))"


@query("q107_neighbour_information", f"""WITH d AS (SELECT c_custkey AS id, name, x, t, count(*) OVER (PARTITION BY name, t) AS n FROM (SELECT c_custkey, c_mktsegment AS t, 'c_acctbal' AS name, CAST(c_acctbal AS DOUBLE) AS x FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer)),
    near AS (SELECT a.name, a.id, a.x, a.n, abs(a.x - b.x) AS far, row_number() OVER (PARTITION BY a.name, a.id ORDER BY abs(a.x - b.x)) AS k FROM d a JOIN d b ON a.name = b.name AND a.t = b.t AND a.id <> b.id),
    own AS (SELECT * FROM near WHERE k = least(3, n - 1)),
    m AS (SELECT own.name, own.id, own.n, own.k, count(*) AS m FROM own JOIN d ON d.name = own.name AND (abs(d.x - own.x) < own.far OR d.x = own.x) GROUP BY 1, 2, 3, 4)
    SELECT name, round(greatest(0, {_PSI.format(n="count(*)")} + avg({_PSI.format(n="k")}) - avg({_PSI.format(n="n")}) - avg({_PSI.format(n="m")})), 6) AS mi FROM m GROUP BY 1""")
def q107(t):
    return rounded(features.neighbour_information(t("customer"), ["c_acctbal", "c_nationkey"], "c_mktsegment"), "mi", places=6)


_ASKED = ("show monthly price trend", "average price by priority", "top 2 status by price", "how many records per status", "pie chart of priority", "distribution of price", "maximum price by status", "quarterly price trend by status", "median price by status", "what is the total price", "count of status", "how many rows")


@query("q108_answers", """WITH d AS (SELECT CAST(o_totalprice AS DOUBLE) AS price, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS date FROM orders),
    e AS (SELECT min(price) AS lo, max(price) AS hi FROM d),
    a AS (SELECT 1 AS id, strftime(date, '%Y-%m') AS key, NULL AS color, sum(price) AS value, NULL AS o FROM d GROUP BY 2
      UNION ALL SELECT 2, priority, NULL, avg(price), -avg(price) FROM d GROUP BY 2
      UNION ALL SELECT 3, status, NULL, sum(price), -sum(price) FROM d GROUP BY 2
      UNION ALL SELECT 5, priority, NULL, count(*), NULL FROM d GROUP BY 2
      UNION ALL SELECT 6, lpad(CAST(CAST(least(floor((price - lo) / (hi - lo) * 30), 29) AS INT) AS VARCHAR), 2, '0'), NULL, count(*), NULL FROM d, e GROUP BY 2
      UNION ALL SELECT 7, status, NULL, max(price), -max(price) FROM d GROUP BY 2
      UNION ALL SELECT 8, year(date) || 'Q' || quarter(date), status, sum(price), NULL FROM d GROUP BY 2, 3
      UNION ALL SELECT 9, status, NULL, median(price), -median(price) FROM d GROUP BY 2
      UNION ALL SELECT 10, '', NULL, sum(price), NULL FROM d UNION ALL SELECT 11, '', NULL, count(DISTINCT status), NULL FROM d UNION ALL SELECT 4, '', NULL, count(*), NULL FROM d UNION ALL SELECT 12, '', NULL, count(*), NULL FROM d),
    p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o, key, color) AS place FROM a)
    SELECT id, CAST(place AS INT) AS place, key, color, round(value, 2) AS value FROM p WHERE id <> 3 OR place <= 2""")
def q108(t):
    df = t("orders").select(F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("date"))
    asked = df.sparkSession.createDataFrame(list(enumerate(_ASKED, 1)), "id int, question string")
    compiled = questions.compile_requests(asked, "question", ["price"], ["status", "priority"], ["date"], direct=True)
    return rounded(answers.answer(df, compiled), "value", places=2)


@query("q109_stratified_split", """WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT *, n // 7 AS whole, row_number() OVER (ORDER BY n % 7 DESC, label) AS place FROM c)
    SELECT label, n - t AS train, t AS test FROM (SELECT label, n, whole + CAST(place <= (SELECT CAST(ceil(sum(n) / 7) AS BIGINT) - sum(whole) FROM f) AS INT) AS t FROM f)""")
def q109(t):
    train, test = models.stratified_split(t("orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("label")), share=(1, 7))
    both = train.withColumn("t", F.lit(0)).union(test.withColumn("t", F.lit(1)))
    return both.groupBy("label").agg(F.count_if(F.col("t") == 0).alias("train"), F.count_if(F.col("t") == 1).alias("test"))


@query("q110_encode_as_trained", """WITH s AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) - 1 AS code FROM (SELECT DISTINCT o_orderstatus FROM orders)),
    p AS (SELECT o_orderpriority, avg(o_totalprice) AS m, 1 / (1 + exp(-(count(*) - 1.0))) AS w FROM orders GROUP BY 1), g AS (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS d FROM orders)
    SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE code END AS DOUBLE) AS o_orderstatus, round(CASE WHEN o_orderkey % 7 = 0 THEN a ELSE w * m + (1 - w) * a END, 2) AS o_orderpriority_target, round((o_totalprice - a) / d, 6) AS o_totalprice
    FROM orders JOIN s USING (o_orderstatus) JOIN p USING (o_orderpriority), g""")
def q110(t):
    df = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    fitted = encoders.RowEncoder(methods=json.dumps({"o_orderstatus": "label", "o_orderpriority": "target"}), columns=["o_totalprice"], scaled=["o_totalprice"], target="o_totalprice", method="standard").fit(df)
    path = f"{shared_folder(df.sparkSession)}/encoder-{uuid.uuid4().hex}"
    fitted.save(path)
    unseen = lambda c, n: F.when(F.col("o_orderkey") % n == 0, "unseen").otherwise(F.col(c))
    new = df.withColumns({"o_orderstatus": unseen("o_orderstatus", 10), "o_orderpriority": unseen("o_orderpriority", 7)})
    out = encoders.RowEncoderModel.load(path).transform(new).drop("o_orderpriority")
    return rounded(rounded(out, "o_orderpriority_target", places=2), "o_totalprice", places=6)


@query("q111_resolve_names")
def q111(t):
    """Names of nations with a letter lost, as columns of a table of all of them."""
    known = sorted(x["n_name"] for x in t("nation").select("n_name").limit(1000).collect())
    written = t("nation").select(F.concat(F.lower(F.substring("n_name", 1, 3)), F.substring("n_name", 5, 100)).alias("written"))
    return written.withColumn("resolved", names.resolved(F.col("written"), known))


@query("q112_fingerprint", """WITH h AS (SELECT sha256(coalesce(length(c_mktsegment) || ':' || c_mktsegment, 'n') || coalesce(length(CAST(c_custkey AS VARCHAR)) || ':' || c_custkey, 'n') || coalesce(length(CAST(c_nationkey AS VARCHAR)) || ':' || c_nationkey, 'n')) AS h FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer)),
    x AS (SELECT CAST('0x' || substr(h, 1, 15) AS BIGINT) AS low, CAST('0x' || substr(h, 16, 15) AS BIGINT) AS high FROM h)
    SELECT count(*) AS rows, CAST(sum(low) AS VARCHAR) AS low, CAST(sum(high) AS VARCHAR) AS high FROM x""")
def q112(t):
    df = _gaps(t("customer").select("c_nationkey", "c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", 9)
    df = df.select("c_nationkey", F.col("c_mktsegment").alias("aa"), "c_custkey")  # columns count in the order of their names
    return cache.fingerprint(df).select("rows", F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high"))


@query("q113_search_within")
def q113(t):
    """The settings of a decision tree that were judged within two minutes, and which one is best."""
    found = tuning.search_within(_orders_rows(t), "decision_tree", "classification", seconds=120, most=4)
    rows = [(json.dumps(setting, sort_keys=True), value, setting == found.setting) for setting, value in found.tried]
    return rounded(t("orders").sparkSession.createDataFrame(rows, "setting string, score double, best boolean"), "score")


@query("q114_group_quantiles", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.01), 4) AS low, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5), 4) AS middle,
    round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.999), 4) AS high FROM lineitem GROUP BY 1, 2""")
def q114(t):
    found = quantiles.quantiles(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", (0.01, 0.5, 0.999))
    return rounded(found.select("l_returnflag", "l_linestatus", "n", *(F.col("q")[i].alias(c) for i, c in enumerate(("low", "middle", "high")))), "low", "middle", "high")
