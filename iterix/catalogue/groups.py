"""Aggregates and row-by-row functions, over groups and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iterix.catalogue.common import Entry, columns, holes, rounded
from iterix.operators.groups import group_exec, run, run_exec
from iterix.plans.compile import Stat, fn, reuse_calls, stat
from iterix.sources.tables import table

SLOPE = "sum((x - mean(x)) * (y - mean(y))) / sum((x - mean(x))^2)"
INTERCEPT = f"{{ b <- {SLOPE}; mean(y) - b * mean(x) }}"
VARIANCE = "sum((x - mean(x))^2) / (length(x) - 1)"
ZSCORE = "(x - mean(x)) / (sum(square(x - mean(x))) / (length(x) - 1))^0.5"

LINES = {"x": "l_quantity", "y": "l_extendedprice", "z": "l_discount"}
PARTS = {"x": "p_retailprice", "y": "p_size"}


def by(name: str, source: str, data: dict, key: str | list[str], digits: int = 4, more: dict | None = None, **options) -> object:
    s = stat(source, list(data) + list(more or {}))

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(group_exec(s, table(spark, folder, name), columns(data), key, more, **options), digits)

    return query


def lines(source: str, names: str, digits: int = 4) -> object:
    return by("lineitem", source, {n: LINES[n] for n in names}, "l_suppkey", digits)


def lines_sql(value: str, digits: int = 4) -> str:
    return f"SELECT l_suppkey, round({value}, {digits}) AS value FROM lineitem GROUP BY l_suppkey"


def parts(source: str, digits: int = 4, data: dict | None = None) -> object:
    """A value for each part, in groups by brand."""
    return by("part", source, data or PARTS, "p_brand", digits, order="p_partkey")


def parts_sql(value: str) -> str:
    return f"SELECT p_brand, p_partkey, {value} AS value FROM part"


_CENTRED = "(SELECT *, avg(l_quantity) OVER w AS mx, avg(l_extendedprice) OVER w AS my FROM lineitem WINDOW w AS (PARTITION BY l_suppkey))"
_SLOPE_SQL = "sum((l_quantity - mx) * (l_extendedprice - my)) / sum((l_quantity - mx) ** 2)"


def _reused(spark: SparkSession, folder: str) -> DataFrame:
    plain = stat(SLOPE, ["x", "y"], optimize=False)
    named = Stat(plain.params, plain.original, reuse_calls(plain.processed))
    return rounded(group_exec(named, table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"], "l_suppkey"))


def _traced(spark: SparkSession, folder: str) -> DataFrame:
    s = stat(lambda x, w=2.0, *rest: fn.sum(x * w, *rest, na_rm=True) / fn.length(x))
    return rounded(group_exec(s, table(spark, folder, "lineitem"), {"x": "l_quantity", 0: "l_tax"}, "l_suppkey", {"w": 3.0}))


def _defaults(spark: SparkSession, folder: str) -> DataFrame:
    s = stat("sum(x) * k + m", ["x", "k", "m"], defaults={"k": 2.0, "m": stat("k * 10", ["k"]).original})
    return rounded(group_exec(s, table(spark, folder, "lineitem"), ["l_quantity"], "l_suppkey"))


def _outside(spark: SparkSession, folder: str) -> DataFrame:
    s = stat("sum(x) * largest(w)", ["x"], env={"largest": max, "w": [3.0, 5.0, 4.0]})
    return rounded(group_exec(s, table(spark, folder, "lineitem"), ["l_quantity"], "l_suppkey"))


def _spread(spark: SparkSession, folder: str) -> DataFrame:
    s = stat("sum(..., na.rm = na)", ["...", "na"])
    return rounded(group_exec(s, table(spark, folder, "lineitem"), ["l_quantity", "l_tax"], "l_suppkey", {"na": True}))


def _whole(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(run(stat(SLOPE), table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"]))


def _whole_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(run(stat("x - mean(x)"), table(spark, folder, "supplier"), ["s_acctbal"], order="s_suppkey"))


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(run_exec(stat("sum(x) / length(x)"), table(spark, folder, "events"), ["value"], "event_type", order="ts", peers=True))


_EVENTS = {"x": lambda: holes("value", 90.0)}
_ODD = {"x": lambda: F.when(F.col("value") >= 20, F.when(F.col("value") > 80, F.lit(float("nan"))).otherwise(F.col("value"))), "y": lambda: F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 7)}
_ODD_SQL = "(SELECT *, CASE WHEN value < 20 THEN NULL WHEN value > 80 THEN 'nan'::DOUBLE ELSE value END AS x, CASE WHEN user_id % 3 > 0 THEN user_id % 7 END AS y FROM events)"


def odd(source: str) -> object:
    """A value for each event, of x with NULL and NaN and y with NULL."""
    return by("events", source, _ODD, "event_type", order="event_id")


def odd_sql(value: str) -> str:
    """gt: whether x is above 50, NULL where x is missing."""
    return f"SELECT event_type, event_id, {value} AS value FROM (SELECT *, CASE WHEN NOT isnan(x) THEN x > 50 END AS gt FROM {_ODD_SQL})"


_E = "(SELECT *, CASE WHEN value <= 90 THEN value END AS v FROM events)"

GROUPS: dict[str, Entry] = {
    "group_sum": (lines("sum(y)", "y"), lines_sql("sum(l_extendedprice)")),
    "group_mean": (lines("mean(y)", "y"), lines_sql("avg(l_extendedprice)")),
    "group_mean1": (lines("mean1(y)", "y"), lines_sql("avg(l_extendedprice)")),
    "group_length": (lines("length(x)", "x"), "SELECT l_suppkey, count(*) AS value FROM lineitem GROUP BY l_suppkey"),
    "group_sum_multi": (lines("sum(x, y, 1)", "xy"), lines_sql("sum(l_quantity) + sum(l_extendedprice) + 1")),
    "group_sum_integer": (by("part", "sum(y)", {"y": "p_size"}, "p_brand"), "SELECT p_brand, sum(p_size)::BIGINT AS value FROM part GROUP BY p_brand"),
    "group_small": (by("lineitem", SLOPE.replace("sum((x - mean(x))^2)", "(sum((x - mean(x))^2) + 1)"), {"x": "l_quantity", "y": "l_extendedprice"}, "l_orderkey"), f"SELECT l_orderkey, round(sum((l_quantity - mx) * (l_extendedprice - my)) / (sum((l_quantity - mx) ** 2) + 1), 4) AS value FROM {_CENTRED.replace('l_suppkey', 'l_orderkey')} GROUP BY l_orderkey"),
    "group_slope": (lines(SLOPE, "xy"), f"SELECT l_suppkey, round({_SLOPE_SQL}, 4) AS value FROM {_CENTRED} GROUP BY l_suppkey"),
    "group_intercept": (lines(INTERCEPT, "xy"), f"SELECT l_suppkey, round(avg(l_extendedprice) - {_SLOPE_SQL} * avg(l_quantity), 4) AS value FROM {_CENTRED} GROUP BY l_suppkey"),
    "group_variance": (lines(VARIANCE, "x"), lines_sql("var_samp(l_quantity)")),
    "group_weighted_mean": (lines("sum(x * z) / sum(z)", "xz"), lines_sql("sum(l_quantity * l_discount) / sum(l_discount)")),
    "group_two_keys": (by("lineitem", "mean(x)", {"x": "l_quantity"}, ["l_returnflag", "l_linestatus"]), "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS value FROM lineitem GROUP BY ALL"),
    "group_sum_na": (by("events", "sum(x)", _EVENTS, "event_type"), f"SELECT event_type, round(CASE WHEN count(*) = count(v) THEN sum(v) END, 4) AS value FROM {_E} GROUP BY event_type"),
    "group_sum_na_rm": (by("events", "sum(x, na.rm = TRUE)", _EVENTS, "event_type"), f"SELECT event_type, round(sum(v), 4) AS value FROM {_E} GROUP BY event_type"),
    "group_mean_na_rm": (by("events", "mean(x, na.rm = TRUE)", _EVENTS, "event_type"), f"SELECT event_type, round(avg(v), 4) AS value FROM {_E} GROUP BY event_type"),
    "group_all": (by("orders", "all(x > 900)", {"x": "o_totalprice"}, "o_custkey"), "SELECT o_custkey, bool_and(o_totalprice > 900) AS value FROM orders GROUP BY o_custkey"),
    "group_any": (by("orders", "any(x > 300000, x < 1000)", {"x": "o_totalprice"}, "o_custkey"), "SELECT o_custkey, bool_or(o_totalprice > 300000 OR o_totalprice < 1000) AS value FROM orders GROUP BY o_custkey"),
    "group_any_na": (by("events", "any(x > 89, na.rm = FALSE)", _EVENTS, "user_id"), f"SELECT user_id, CASE WHEN bool_or(v > 89) THEN true WHEN count(*) > count(v) THEN NULL ELSE false END AS value FROM {_E} GROUP BY user_id"),
    "group_scalar_logic": (by("orders", "mean(x) > 150000 && length(x) > 5 || any(x > 400000)", {"x": "o_totalprice"}, "o_custkey"), "SELECT o_custkey, avg(o_totalprice) > 150000 AND count(*) > 5 OR bool_or(o_totalprice > 400000) AS value FROM orders GROUP BY o_custkey"),
    "group_if_else": (by("orders", "if (mean(x) > 150000) sum(x) else if (length(x) > 9) -sum(x) else 0", {"x": "o_totalprice"}, "o_custkey", 2), "SELECT o_custkey, round(CASE WHEN avg(o_totalprice) > 150000 THEN sum(o_totalprice) WHEN count(*) > 9 THEN -sum(o_totalprice) ELSE 0 END, 2) AS value FROM orders GROUP BY o_custkey"),
    "group_whole_keys": (by("part", "length(x)", {"x": "p_size"}, "p_retailprice"), "SELECT trunc(p_retailprice)::BIGINT AS p_retailprice, count(*) AS value FROM part GROUP BY ALL"),
    "group_reuse": (_reused, f"SELECT l_suppkey, round({_SLOPE_SQL}, 4) AS value FROM {_CENTRED} GROUP BY l_suppkey"),
    "group_traced": (_traced, lines_sql("(sum(l_quantity * 3) + sum(l_tax)) / count(*)")),
    "group_defaults": (_defaults, lines_sql("sum(l_quantity) * 2 + 20")),
    "group_constant_call": (_outside, lines_sql("sum(l_quantity) * 5")),
    "group_dots": (_spread, lines_sql("sum(l_quantity) + sum(l_tax)")),
    "group_runs": (_runs, "SELECT run, event_type, round(avg(value), 4) AS value FROM (SELECT *, sum(step) OVER (ORDER BY ts) AS run FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY ts) THEN 0 ELSE 1 END AS step FROM events)) GROUP BY run, event_type"),
    "whole_slope": (_whole, "SELECT round(sum((l_quantity - mx) * (l_extendedprice - my)) / sum((l_quantity - mx) ** 2), 4) AS value FROM (SELECT *, avg(l_quantity) OVER () AS mx, avg(l_extendedprice) OVER () AS my FROM lineitem)"),
    "whole_rows": (_whole_rows, "SELECT s_suppkey, round(s_acctbal - avg(s_acctbal) OVER (), 4) AS value FROM supplier"),
    "rows_arithmetic": (parts("(x + y) * 2 - x / (y + 0.7)"), parts_sql("round((p_retailprice + p_size) * 2 - p_retailprice / (p_size + 0.7), 4)")),
    "rows_power": (parts("x^0.5 + y^3"), parts_sql("round(p_retailprice ** 0.5 + p_size ** 3, 4)")),
    "rows_square": (parts("x^2 + square(y)", 2), parts_sql("round(p_retailprice * p_retailprice + p_size * p_size, 2)")),
    "rows_unary": (parts("-x + +y"), parts_sql("round(-p_retailprice + p_size, 4)")),
    "rows_integer": (parts("-y * 3L + y", data={"y": "p_size"}), parts_sql("(-2 * p_size)::BIGINT")),
    "rows_zero_divisor": (parts("(x - 1000) / (y - y)"), parts_sql("CASE WHEN p_retailprice > 1000 THEN 'inf'::DOUBLE WHEN p_retailprice < 1000 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END")),
    "rows_compare": (parts("(x > 1200) + (x >= 1000) + (y < 10) * (y <= 20) + (y == 7) - (y != 8)"), parts_sql("((p_retailprice > 1200)::BIGINT + (p_retailprice >= 1000)::BIGINT + (p_size < 10)::BIGINT * (p_size <= 20)::BIGINT + (p_size = 7)::BIGINT - (p_size <> 8)::BIGINT)::BIGINT")),
    "rows_logic": (parts("(x > 1200 & y < 30) | !(y == 3)"), parts_sql("(p_retailprice > 1200 AND p_size < 30) OR NOT (p_size = 3)")),
    "rows_ifelse": (parts("ifelse(x > mean(x), x, -y)"), parts_sql("round(CASE WHEN p_retailprice > avg(p_retailprice) OVER (PARTITION BY p_brand) THEN p_retailprice ELSE -p_size END, 4)")),
    "rows_compare_na": (odd("x > 50"), odd_sql("gt")),
    "rows_equal_na": (odd("(x == x) & (y != 3)"), odd_sql("(CASE WHEN NOT isnan(x) THEN true END) AND y <> 3")),
    "rows_logic_na": (odd("(x > 50 & y > 3) | !(y > 1)"), odd_sql("(gt AND y > 3) OR NOT (y > 1)")),
    "rows_ifelse_na": (odd("ifelse(x > 50, y, -1)"), odd_sql("CASE WHEN gt THEN y WHEN NOT gt THEN -1 END::DOUBLE")),
    "rows_power_na": (odd("x^0 + 1^x + y^0"), odd_sql("3::DOUBLE")),
    "group_ifelse_first": (by("events", "ifelse(sum(x) > 5000, x, -x)", {"x": "value"}, "user_id", order="event_id"), "SELECT user_id, round(CASE WHEN sum(value) > 5000 THEN arg_min(value, event_id) ELSE -arg_min(value, event_id) END, 4) AS value FROM events GROUP BY user_id"),
    "rows_centre": (by("customer", "x - mean(x)", {"x": "c_acctbal"}, "c_nationkey", order="c_custkey"), "SELECT c_nationkey, c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS value FROM customer"),
    "rows_zscore": (by("customer", ZSCORE, {"x": "c_acctbal"}, "c_nationkey", order="c_custkey"), "SELECT c_nationkey, c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / sqrt(var_samp(c_acctbal) OVER w), 4) AS value FROM customer WINDOW w AS (PARTITION BY c_nationkey)"),
    "rows_seq_along": (by("events", "x * seq_along(x)", {"x": "value"}, "user_id", order="event_id"), "SELECT user_id, event_id, round(value * row_number() OVER (PARTITION BY user_id ORDER BY event_id), 4) AS value FROM events"),
}
