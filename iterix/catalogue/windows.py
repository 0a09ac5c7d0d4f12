"""Rolling windows over the events, by rows and by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from iterix.catalogue.common import UNTIED, Entry, columns, rounded
from iterix.catalogue.groups import SLOPE
from iterix.operators.windows import rollat_exec, rollbw_exec, rollby_exec, rolli_exec
from iterix.plans.compile import stat
from iterix.sources.tables import table

#: Microseconds.
HOUR = 3600e6
DAY = 24 * HOUR


def rows(source: str, n: int | str, data: dict | None = None, digits: int = 4, **options) -> object:
    s = stat(source, list(data or {"x": "value"}))

    def query(spark: SparkSession, folder: str) -> DataFrame:
        events = table(spark, folder, "events")
        if isinstance(n, str):
            events = events.withColumn(n, F.col("event_id") % 4)
        return rounded(rolli_exec(s, events, columns(data or {"x": "value"}), n, order="ts", **options).select("iter", "value"), digits)

    return query


def rows_sql(lo: int, hi: int, partial: bool = False, by: int = 1, value: str = "sum(x) OVER f", empty: str = "0") -> str:
    whole = "" if partial else f"CASE WHEN k + ({lo}) >= 1 AND k + ({hi}) <= n THEN "
    frame = " AND ".join(f"{abs(b)} {'PRECEDING' if b < 0 else 'FOLLOWING'}" for b in (lo, hi))
    return (
        f"SELECT (k - 1) // {by} + 1 AS iter, round({whole}coalesce(v, {empty}){'' if partial else ' END'}, 4) AS value FROM (SELECT k, n, {value} AS v "
        f"FROM (SELECT value AS x, row_number() OVER (ORDER BY ts) AS k, count(*) OVER () AS n FROM events) WINDOW f AS (ORDER BY k ROWS BETWEEN {frame})) WHERE (k - 1) % {by} = 0"
    )


def spans(source: str, **options) -> object:
    s = stat(source, ["x"])

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return rounded(rollby_exec(s, table(spark, folder, "events"), {"x": "value"}, position="ts", **options).select("iter", "value"))

    return query


_E = "e AS (SELECT epoch_us(ts)::DOUBLE AS p, value AS x FROM events)"


def spans_sql(width: float, by: float, offset: float = 0, start: str = "min(p)", end: str = "max(p)", bounds: str = "[)", value: str = "coalesce(sum(x), 0)") -> str:
    left, right = (">=" if bounds[0] == "[" else ">"), ("<=" if bounds[1] == "]" else "<")
    return (
        f"WITH {_E}, s AS (SELECT {start} AS a, {end} AS b FROM e), w AS (SELECT i + 1 AS iter, a + ({offset!r}) + {by!r}::DOUBLE * i AS l FROM (SELECT a, unnest(range(0, floor((b - a) / {by!r})::BIGINT + 1)) AS i FROM s)) "
        f"SELECT iter, round({value}, 4) AS value FROM w LEFT JOIN e ON p {left} l AND p {right} l + {width!r} GROUP BY iter"
    )


START, END = 1704412800000000.0, 1705017600000000.0  # 2024-01-05 and 2024-01-12


def _at(spark: SparkSession, folder: str) -> DataFrame:
    at = table(spark, folder, "orders").select(F.col("o_orderkey").alias("iter"), (F.lit(START) + F.col("o_orderkey") * HOUR / 7).alias("at"))
    return rounded(rollat_exec(stat("sum(x)"), table(spark, folder, "events"), ["value"], 2 * HOUR, at, -HOUR, "ts").select("iter", "value"))


def _at_self(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rollat_exec(stat(f"mean(x) * {UNTIED}"), table(spark, folder, "events"), ["value"], 6 * HOUR, None, -6 * HOUR, "ts", "(]").select("iter", "value"))


def _between(spark: SparkSession, folder: str) -> DataFrame:
    ends = spark.range(200).select((F.col("id") + 1).alias("iter"), (F.lit(START) + F.col("id") * HOUR).alias("left"), (F.lit(START) + F.col("id") * F.col("id") * HOUR / 20).alias("right"))
    return rounded(rollbw_exec(stat("sum(x) + length(x)"), table(spark, folder, "events"), ["value"], ends, None, "ts").select("iter", "value"))


def _by_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(rollby_exec(stat("sum(x)"), table(spark, folder, "events"), ["value"], 10, 5, order="ts").select("iter", "value"))


_ROLL_SLOPE = (
    "WITH e AS (SELECT value AS y, (epoch_us(ts) - 1704067200000000)::DOUBLE / 1e9 AS x, row_number() OVER (ORDER BY ts) AS k, count(*) OVER () AS n FROM events), "
    "j AS (SELECT a.k, a.n, b.x, b.y, avg(b.x) OVER (PARTITION BY a.k) AS mx, avg(b.y) OVER (PARTITION BY a.k) AS my FROM e a JOIN e b ON b.k BETWEEN a.k - 9 AND a.k + 10) "
    "SELECT k AS iter, round(CASE WHEN k - 9 >= 1 AND k + 10 <= n THEN sum((x - mx) * (y - my)) / sum((x - mx) ** 2) END, 3) AS value FROM j GROUP BY k, n"
)


def _since_start() -> Column:
    return (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(1e9)


WINDOWS: dict[str, Entry] = {
    "rolli_left": (rows("sum(x)", 5, align="left"), rows_sql(0, 4)),
    "rolli_center": (rows("sum(x)", 4), rows_sql(-1, 2)),
    "rolli_right": (rows("mean(x)", 5, align="right"), rows_sql(-4, 0, value="avg(x) OVER f", empty="NULL")),
    "rolli_offset": (rows("sum(x)", 3, align=2, partial=True), rows_sql(2, 4, True)),
    "rolli_partial": (rows("sum(x * x) / length(x)", 7, partial=True), rows_sql(-3, 3, True, value="avg(x * x) OVER f", empty="NULL")),
    "rolli_by": (rows("sum(x)", 5, by=3, align="left", partial=True), rows_sql(0, 4, True, 3)),
    "rolli_wide": (rows("any(x > 99.9) + 0L", 501, partial=True), rows_sql(-250, 250, True, value="(max(x) OVER f > 99.9)::INTEGER").replace("round(coalesce(v, 0), 4)", "coalesce(v, 0)::BIGINT")),
    "rolli_widths": (
        rows("sum(x)", "n", align="left", partial=True),
        "WITH e AS (SELECT value AS x, event_id % 4 AS w, row_number() OVER (ORDER BY ts) AS k FROM events) SELECT a.k AS iter, round(coalesce(sum(b.x), 0), 4) AS value FROM e a LEFT JOIN e b ON b.k >= a.k AND b.k < a.k + a.w GROUP BY a.k",
    ),
    "rolli_slope": (rows(SLOPE, 20, {"x": _since_start, "y": "value"}, 3), _ROLL_SLOPE),
    "rollby_closed_open": (spans("sum(x)", width=6 * HOUR, by=2 * HOUR), spans_sql(6 * HOUR, 2 * HOUR)),
    "rollby_closed_closed": (spans("length(x)", width=DAY, by=DAY, bounds="[]"), spans_sql(DAY, DAY, bounds="[]", value="count(x)")),
    "rollby_open_closed": (spans("sum(x)", width=DAY, by=DAY, bounds="(]"), spans_sql(DAY, DAY, bounds="(]")),
    "rollby_open_open": (spans(f"mean(x) * {UNTIED}", width=HOUR, by=HOUR, bounds="()"), spans_sql(HOUR, HOUR, bounds="()", value=f"coalesce(avg(x) * {UNTIED}, 'nan'::DOUBLE)")),
    "rollby_offset": (spans("sum(x)", width=DAY, by=DAY, offset=-DAY / 2), spans_sql(DAY, DAY, -DAY / 2)),
    "rollby_start_end": (spans("sum(x)", width=3 * DAY, by=HOUR, start=START, end=END), spans_sql(3 * DAY, HOUR, start=f"min({START!r}::DOUBLE)", end=f"min({END!r}::DOUBLE)")),
    "rollby_variance": (spans(f"sum((x - mean(x))^2) * {UNTIED}", width=6 * HOUR, by=3 * HOUR), spans_sql(6 * HOUR, 3 * HOUR, value=f"coalesce(var_pop(x) * count(x), 0) * {UNTIED}")),
    "rollby_array": (spans("x[1] + x[length(x)]", width=DAY, by=DAY), spans_sql(DAY, DAY, value="arg_min(x, p) + arg_max(x, p)")),
    "rollby_rows": (_by_rows, "WITH e AS (SELECT value AS x, row_number() OVER (ORDER BY ts) AS k FROM events) SELECT a.k // 5 + 1 AS iter, round(sum(b.x), 4) AS value FROM e a JOIN e b ON b.k >= a.k AND b.k < a.k + 10 WHERE (a.k - 1) % 5 = 0 GROUP BY a.k"),
    "rollat": (_at, f"WITH {_E}, w AS (SELECT o_orderkey AS iter, {START!r} + o_orderkey * {HOUR!r} / 7 - {HOUR!r} AS l FROM orders) SELECT iter, round(coalesce(sum(x), 0), 4) AS value FROM w LEFT JOIN e ON p >= l AND p < l + {2 * HOUR!r} GROUP BY iter"),
    "rollat_self": (_at_self, f"WITH {_E}, w AS (SELECT row_number() OVER (ORDER BY p) AS iter, p AS a FROM e) SELECT iter, round(avg(x) * {UNTIED}, 4) AS value FROM w LEFT JOIN e ON p > a - {6 * HOUR!r} AND p <= a GROUP BY iter"),
    "rollbw": (_between, f"WITH {_E}, w AS (SELECT i + 1 AS iter, {START!r} + i * {HOUR!r} AS l, {START!r} + i * i * {HOUR!r} / 20 AS r FROM (SELECT unnest(range(0, 200)) AS i)) SELECT iter, round(coalesce(sum(x), 0) + count(x), 4) AS value FROM w LEFT JOIN e ON p >= l AND p < r GROUP BY iter"),
}
