"""Names that clash with nothing, plans, checks, and windows at the rows' own places."""

import random
import warnings

import pytest
from pyspark.sql import functions as F

from iterix import StatError, group_exec, plan, rollat_exec, rolli_exec, run_exec, stat


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(k, k % 3, float(k * k % 7)) for k in range(40)], "k long, g long, x double").repartition(3).cache()


@pytest.mark.parametrize("name", ["_range", "_at", "_idx", "_x0", "_c0", "_value", "_row", "run", "iter", "a.b"])
def test_any_column_name(df, name):
    want = {(r.g, r.value) for r in group_exec(stat("sum(x)"), df, "x", "g").collect()}
    named = df.withColumnRenamed("g", name)
    assert {(r[0], r[1]) for r in group_exec(stat("sum(x)"), named, "x", name).collect()} == want
    ordered = df.withColumnRenamed("k", name)
    runs = [tuple(r) for r in run_exec(stat("length(x)"), ordered.withColumn("h", F.floor(F.col(f"`{name}`") / 4)), "x", "h", order=name).collect()]
    assert sorted(runs) == [(k + 1, k, 4) for k in range(10)]
    if name != "iter":
        rolled = rolli_exec(stat("sum(x)"), ordered, "x", 3, order=name, align="left")
        assert rolled.columns == ["iter", name, "value"] and rolled.count() == 40
    each = group_exec(stat("x - mean(x)"), ordered, "x", "g", order=name)
    assert each.columns == ["g", name, "value"] and each.count() == 40


def test_clashes_in_the_result_are_refused(df):
    with pytest.raises(StatError, match="two columns `value`"):
        group_exec(stat("sum(x)"), df.withColumnRenamed("g", "value"), "x", "value")
    assert group_exec(stat("sum(x)"), df.withColumnRenamed("g", "value"), "x", "value", name="total").columns == ["value", "total"]
    with pytest.raises(StatError, match="two columns `iter`"):
        rolli_exec(stat("sum(x)"), df.withColumnRenamed("k", "iter"), "x", 3, order="iter")


def test_ifelse_of_one_test_and_longer_values(df):
    got = {r.g: r.value for r in group_exec(stat("ifelse(sum(x) > 40, x, -x)"), df, "x", "g", order="k").collect()}
    rows = [r for r in df.orderBy("k").collect()]
    for g in range(3):
        x = [r.x for r in rows if r.g == g]
        assert got[g] == (x[0] if sum(x) > 40 else -x[0])


def test_internal_forms_are_refused():
    with pytest.raises(StatError):
        stat("vcopy(x)")


def test_recycling_warns():
    with pytest.warns(UserWarning, match="multiple"):
        assert stat("x + y")([1, 2, 3, 4], [10, 20, 30]) == [11, 22, 33, 14]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert stat("x + y")([1, 2, 3, 4], [10, 20]) == [11, 22, 13, 24]


def test_check_compares_with_the_code_as_written():
    s = stat("{ m <- mean(x); sum((x - mean(x))^2) / sum((x - m)^2) }", check=True)
    out = s([1.0, 2.0, 4.5])
    assert out == [1.0] and out.identical and out.all_equal
    assert not hasattr(stat("mean(x)")([1.0]), "identical")


def test_plan(df):
    text = plan(stat("sum((x - mean(x))^2) / length(x)"), df, "x", "g")
    assert "level 1: mean(x); by g" in text and "last: sum(square((x - mean(x)))), length()" in text
    assert "arrays" in plan(stat("x[1]"), df, "x", "g")
    assert "each row: (x - mean(x))" in plan(stat("x - mean(x)"), df, "x", "g")


@pytest.mark.parametrize("bounds", ["()", "[)", "(]", "[]"])
@pytest.mark.parametrize("width,offset", [(6.0, -3.0), (0.0, 0.0), (1.0, 2.0), (5.0, -20.0), (1000.0, -500.0), (2.5, -1.0)])
def test_windows_at_the_rows_own_places(spark, bounds, width, offset):
    places = [0, 0, 1, 3, 3, 3, 4, 10, 11, 25, 40, 41, 41, 60]
    df = spark.createDataFrame([(float(p), float(2**k)) for k, p in enumerate(places)], "p double, x double")
    got = sorted((r.iter, r.left, r.right, r.value) for r in rollat_exec(stat("sum(x)"), df, "x", width, offset=offset, position="p", bounds=bounds).collect())
    want = []
    for k, p in enumerate(places, 1):
        lo, hi = p + offset, p + offset + width
        inside = [2.0**j for j, q in enumerate(places) if (q >= lo if bounds[0] == "[" else q > lo) and (q <= hi if bounds[1] == "]" else q < hi)]
        want.append((k, lo, hi, sum(inside)))
    assert got == want


@pytest.mark.parametrize("bounds", ["()", "[]"])
def test_windows_of_one_width_do_not_go_through_their_rows(spark, bounds):
    g = random.Random(7)
    places = [g.random() * 5 for _ in range(300)] + [2.5] * 200 + [1e4]
    df = spark.createDataFrame([(p, float(k % 7)) for k, p in enumerate(places)], "p double, x double").repartition(3)
    at = [-50.0, 0.0, 2.5, 2.5, 1.25, 4.9, 30.0, 1e4, 1e6, 2.499999]
    for source, of in (("sum(x) + length(x)", lambda v: sum(v) + len(v)), ("any(x > 5) + 0L", lambda v: int(any(x > 5 for x in v)))):
        out = rollat_exec(stat(source), df, "x", 1.5, at, -1.5, "p", bounds)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "RangeFrame" not in plan and "_at_cell" not in plan
        inside = lambda p, a: (a - 1.5 <= p <= a) if bounds == "[]" else (a - 1.5 < p < a)
        assert {r.iter: r.value for r in out.collect()} == {k: of([float(j % 7) for j, p in enumerate(places) if inside(p, a)]) for k, a in enumerate(at, 1)}
    own = rollat_exec(stat("length(x)"), df, "x", 1.5, offset=-1.5, position="p")
    assert "RangeFrame" not in own._jdf.queryExecution().executedPlan().toString()


def test_runs_number_tied_rows_and_round_as_their_sql(spark, tmp_path):
    import duckdb

    from iterix.catalogue import QUERIES, SQL

    given = [(1, "c", 1.0), (2, "a", 2.0), (2, "b", 3.0), (3, "d", 4.0), (4, "d", 4.5), (5, "c", 1.0), (6, "a", 2.0), (6, "b", 2.5), (6, "e", 3.0), (7, "c", 5.0)]
    given += [(100 + k, "runs"[k // 8 % 4], 50.0 + (k * 37 % 1000) / 100 + k // 8 * 0.07) for k in range(400)]
    path = f"{tmp_path}/events.parquet"
    spark.createDataFrame([(float(t), e, v) for t, e, v in given], "ts double, event_type string, value double").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.execute(f"SELECT run, event_type, value FROM ({SQL['group_runs']})").fetchall())
    assert sorted((r.run, r.event_type, r.value) for r in QUERIES["group_runs"](spark, str(tmp_path)).collect()) == want


def test_windows_without_rows_share_no_cell(spark):
    from iterix.operators.lowering import bound
    from iterix.operators.windows import _with_data, window_values

    df = spark.createDataFrame([(float(k), float(k)) for k in range(50)], "p double, x double")
    b, data = _with_data(bound(stat("sum(x)"), ["x"], None), df, [F.col("p").alias("_pos")])
    far = spark.range(1000).select(F.col("id").alias("iter"), (F.col("id") * 7.0).alias("_left"), (F.col("id") * 7.0 + 5).alias("_right"))
    out = window_values(b, data, far, ["iter"], "[)", "_value", ["_pos"], "auto")
    assert {r.iter: r._value for r in out.collect()} == {k: float(sum(x for x in range(50) if 7 * k <= x < 7 * k + 5)) for k in range(1000)}
    assert "xxhash64(iter" in out._jdf.queryExecution().optimizedPlan().toString()
