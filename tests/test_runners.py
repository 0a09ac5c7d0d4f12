"""Both plans against the language on plain lists, and against values known beforehand."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from iterix import StatError, fn, group_exec, process_groups, rollat_exec, rollbw_exec, rollby_exec, rolli_exec, run, run_exec, stat
from iterix.operators.ordered import indexed

NAN, INF, BIG = float("nan"), float("inf"), 1.7976931348623157e308
SLOPE = "sum((x - mean(x)) * (y - mean(y))) / sum((x - mean(x))^2)"


def same(a, b):
    if isinstance(a, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    if a is None or b is None:
        return a is b
    if isinstance(a, bool) or isinstance(b, bool):
        return bool(a) == bool(b)
    if math.isnan(a) or math.isnan(b):
        return math.isnan(a) and math.isnan(b)
    return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.fixture(scope="module")
def rows():
    g = random.Random(1)
    out = []
    for k in range(100):
        x, y = g.random() * g.random() - 0.5, g.random() * g.random() - 0.5
        group = 11 if k == 0 else 12 if k in (1, 2) else g.randint(1, 9) if k % 17 else None
        odd = {5: None, 6: NAN, 7: INF, 8: -INF, 9: None, 40: 5e-324}.get(k, x)
        large = BIG if group == 12 or k % 7 == 3 else x
        out.append((k, group, x, y, odd, large, k % 5 - 2, x > 0 if k % 11 else None))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k int, g int, x double, y double, odd double, large double, i int, b boolean").repartition(3).cache()


NAMES = ["k", "g", "x", "y", "odd", "large", "i", "b"]

STATS = [
    "sum(x)", "sum(odd)", "sum(odd, na.rm = TRUE)", "mean(odd)", "mean(odd, na.rm = TRUE)", "mean1(odd, na.rm = TRUE)", "mean(large)", "length(odd)", "sum(i)", "sum(b)", "sum(b, na.rm = TRUE)", "sum(x, i, 2)", "mean(i)",
    "all(b)", "any(b)", "all(b, na.rm = TRUE)", "any(b, na.rm = TRUE)", "any(odd > 0.4)", "all(odd < INFINITE)", "any(x > 0.3, y > 0.3)", "sum(odd > 0, na.rm = TRUE)",
    SLOPE, "sum((x - mean(x))^2) / (length(x) - 1)", "mean(x) > 0 && mean(y) > 0 || length(x) > 5", "if (mean(x) > 0) sum(x) else sum(y)", "{ m <- mean(x); if (m > 0) { z <- m } else { z <- -m }; z * 2 }",
    "sum(mean(x - mean(x)) + y)", "length(mean(x))", "sum(mean(x), na.rm = TRUE)", "mean(ifelse(odd > 0, 1, -1), na.rm = TRUE)", "-sum(-x) + +length(x)", "sum(x / i, na.rm = TRUE)", "sum(x^i, na.rm = TRUE)", "1 / (length(x) - length(y))", "!all(b)",
]
ROWS = ["x - mean(x)", "x * 2 > y & b", "b | odd > 0", "!odd", "odd == odd", "ifelse(b, x, i)", "x / i", "odd^0", "i^2 + i", "-i", "+b", "seq_along(x) * i", "ifelse(odd > 0, odd, mean(x))"]
VECTORS = [
    "x[c(1, 3)]", "c(sum(x), x, 1)", "rep(x, times = 2, each = 2)", "rep(x, length.out = 7)", "{ x[1] <- 0; x[c(1, 1)] <- c(5, 6); x }", "numeric_along(x)", "numeric_alongn(x, c(1, 2))", "x + c(1, 2, 3)", "c(x, 1) * c(y, 2)",
    "{ s <- 0; for (v in x) s <- s * 0.5 + v; s }", "{ for (v in numeric(0)) x <- 1; v }", "{ z <- 1; for (v in x) if (v > 0) z <- c(z, v) ; sum(z) }", "{ a <- 0; b <- 1; for (j in x) { t <- a + b; a <- b; b <- t }; c(a, b, t) }",
    "{ z <- numeric_along(c(x, 0)); for (p in seq_along(x)) for (q in c(1, 2)) z[p + q - 1] <- z[p + q - 1] + x[p] * q; z }", "ifelse(c(TRUE, NA, FALSE), x, y)", "if (length(x) > 5) x[c(1, 2)] else y[c(1, 2)]", "{}", "seq_along(c(x, x))", "numeric(3)", "rep(x, times = 0)",
]


def expected(source, names, rows, key=1):
    """The statistic of each group on plain lists."""
    s = stat(source.replace("INFINITE", "Inf"), names)
    groups = {}
    for r in rows:
        groups.setdefault(r[key], []).append(r)
    return {g: s(*([r[NAMES.index(n)] for r in sorted(rs)] for n in names)) for g, rs in groups.items()}


def used(source):
    words = set(re.findall(r"\w+", source))
    return [n for n in NAMES[2:] if n in words] or ["x"]


@pytest.mark.parametrize("source", STATS)
def test_single_values_by_group(df, rows, source):
    names, text = used(source), source.replace("INFINITE", "Inf")
    want = expected(source, names, rows)
    if source == "mean(large)":  # plain lists would overflow to the same mean
        assert all(math.isfinite(v[0]) for v in want.values())
    for lowering in ("rows", "arrays"):
        got = {r.g: r.value for r in group_exec(stat(text, names), df, names, "g", order="k", lowering=lowering).collect()}
        assert set(got) == set(want)
        bad = {g: (got[g], want[g]) for g in got if not same(got[g], want[g][0])}
        assert not bad, (lowering, bad)


@pytest.mark.parametrize("source", ROWS)
def test_values_of_rows_by_group(df, rows, source):
    names = used(source)
    want = expected(source, names, rows)
    got = {}
    for r in group_exec(stat(source, names), df, names, "g", order="k", lowering="rows").orderBy("k").collect():
        got.setdefault(r.g, []).append(r.value)
    assert set(got) == set(want) and all(same(got[g], want[g]) for g in got), [(got[g], want[g]) for g in got if not same(got[g], want[g])][:1]


@pytest.mark.parametrize("source", VECTORS + ROWS)
def test_vectors_by_group(df, rows, source):
    names = used(source)
    want = expected(source, names, rows)
    out = group_exec(stat(source, names), df, names, "g", order="k", lowering="arrays")
    got = {g: [] for g in want}
    for r in out.orderBy("idx" if "idx" in out.columns else "g").collect():
        got[r.g].append(r.value)
    assert all(same(got[g], want[g]) for g in want), [(g, got[g], want[g]) for g in got if not same(got[g], want[g])][:1]


def test_types_of_results(df):
    kind = lambda t: group_exec(stat(t), df, {n: n for n in stat(t).params}, "g", order="k").schema["value"].dataType.simpleString()
    assert [kind(t) for t in ("sum(i)", "sum(i, b)", "sum(x)", "length(x)", "mean(i)", "all(b)", "i > 1", "i * 2L", "i / 2L", "i^2", "+b", "x[2]", "i[2]", "c(i, b)")] == [
        "bigint", "bigint", "double", "bigint", "double", "boolean", "boolean", "bigint", "double", "double", "bigint", "double", "bigint", "bigint",
    ]


def test_whole_tables(spark, df, rows):
    want = stat(SLOPE)([r[2] for r in rows], [r[3] for r in rows])
    assert same([run(stat(SLOPE), df, ["x", "y"]).first().value], want)
    assert [r.value for r in run(stat("x - mean(x)"), df, ["x"], order="k").orderBy("k").collect()] == pytest.approx([r[2] - sum(q[2] for q in rows) / 100 for r in rows])
    none = df.limit(0)
    assert run(stat("sum(x)"), none, ["x"]).first().value == 0
    assert math.isnan(run(stat("mean(x)"), none, ["x"]).first().value)
    assert run(stat("c(x, 1)"), none, ["x"], order="k").first().value == 1
    assert group_exec(stat("sum(x)"), none, ["x"], "g").count() == 0
    assert [tuple(r) for r in run(stat("w * 2", ["w"]), df, [], {"w": [1, 2]}).orderBy("idx").collect()] == [(1, 2.0), (2, 4.0)]


def test_constants(spark, df, rows):
    got = dict(group_exec(stat("sum(x * w)", ["x", "w"]), df, ["x"], "g", {"w": [1.0, -1.0]}, order="k").collect())
    want = {}
    for g in {r[1] for r in rows}:
        xs = [r[2] for r in rows if r[1] == g]
        want[g] = sum(x * (1, -1)[k % 2] for k, x in enumerate(xs)) if len(xs) > 1 else xs[0] - xs[0]
    assert all(same(got[g], want[g]) for g in want)
    small = spark.createDataFrame([(0, 1, 1.0), (1, 1, None), (2, 2, 2.0), (3, 2, 3.0)], "k int, g int, x double")
    out = group_exec(stat("sum(x, na.rm = TRUE) * y", ["x", "y"]), small, ["x"], "g", {"y": [-1.0, 1.0, 0.0]}, order="k").orderBy("g", "idx").collect()
    assert [r.value for r in out] == [-1, 1, 0, -5, 5, 0]


def test_errors(spark, df):
    with pytest.raises(StatError):
        group_exec(stat("x && TRUE"), df, ["x"], "g")
    with pytest.raises(StatError):
        group_exec(stat("if (x > 1) 1 else 2"), df, ["x"], "g")
    with pytest.raises(StatError):
        group_exec(stat("{ if (mean(x) > 0) z <- x else z <- 1; sum(z) }"), df, ["x"], "g", order="k")
    with pytest.raises(StatError):
        group_exec(stat("c(x, 1)"), df, ["x"], "g")
    with pytest.raises(StatError):
        group_exec(stat("sum(x)"), df, ["nested"], "g").count() if "nested" in df.columns else run(stat("sum(x)"), df.withColumn("s", F.lit("a")), ["s"])
    with pytest.raises(StatError):
        rolli_exec(stat("x"), df, ["x"], 3, order="k")
    with pytest.raises(StatError):
        rollby_exec(stat("sum(x)"), df, ["x"], 1, 1, position="k", start=5, end=4)
    with pytest.raises(StatError):
        process_groups(df.withColumn("a", F.array(F.lit(1))), "a")
    with pytest.raises(StatError):
        group_exec(stat("{ y <- if (FALSE) x; y }"), df, ["x"], "g", order="k", lowering="arrays")
    for source in ("x[0]", "if (sum(odd) > 0) 1 else 2"):
        with pytest.raises(Exception, match="positive|missing"):
            s = stat(source)
            group_exec(s, df, {p: p for p in s.params}, "g", order="k").collect()


def test_group_keys(spark):
    df = spark.createDataFrame([(1.2, "a", 1.0), (1.9, "a", 2.0), (-0.5, "b", 3.0), (NAN, "b", 4.0), (None, None, 5.0)], "g double, s string, x double")
    assert sorted((tuple(r) for r in group_exec(stat("sum(x)"), df, ["x"], "g").collect()), key=str) == [(0, 3.0), (1, 3.0), (None, 9.0)]
    assert {tuple(r) for r in group_exec(stat("x - mean(x)"), df, ["x"], "s", order="x").collect()} == {("a", 1.0, -0.5), ("a", 2.0, 0.5), ("b", 3.0, -0.5), ("b", 4.0, 0.5), (None, 5.0, 0.0)}
    clash = df.selectExpr("s as value", "x as _a1_0", "x as run", "x as k")
    assert {tuple(r) for r in group_exec(stat("sum((x - mean(x))^2)"), clash, ["_a1_0"], "value", name="v").collect()} == {("a", 0.5), ("b", 0.5), (None, 0.0)}


def test_runs_of_equal_keys(spark):
    df = spark.createDataFrame([(k, g, 1.0) for k, g in enumerate((1, 2, 2, 1, 1, 1, 2, 2))], "k int, g int, x double")
    assert sorted(tuple(r) for r in run_exec(stat("sum(x)"), df, ["x"], "g", order="k").collect()) == [(1, 1, 1.0), (2, 2, 2.0), (3, 1, 3.0), (4, 2, 2.0)]
    g = random.Random(5)
    keys = [g.choice([None, "a", "b"]) for _ in range(300)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(keys)], "k int, g string").repartition(7)
    want, last = [], object()
    for v in keys:
        if v != last:
            want.append([len(want) + 1, v, 0])
            last = v
        want[-1][2] += 1
    assert [list(r) for r in run_exec(stat("length(x)"), df, ["k"], "g", order="k").orderBy("run").collect()] == want


def test_places_in_an_order(spark):
    g = random.Random(6)
    values = [g.choice([None, 1.0, 2.0, NAN, 3.5]) if k % 2 else g.random() for k in range(400)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").repartition(5)
    out, total = indexed(df, ["v"])
    got = [r for r in out.orderBy("_idx").collect()]
    assert total == 400 and [r._idx for r in got] == list(range(1, 401))
    key = lambda v: (2, 0) if v is None else (1, 0) if math.isnan(v) else (0, v)
    assert [key(r.v) for r in got] == sorted(map(key, values))
    assert indexed(df.limit(0), ["v"])[0].count() == 0


W = [1.0, 2.0, 4.0, 8.0, 16.0]
SUM = stat("sum(x)")


@pytest.fixture(scope="module")
def bits(spark):
    """The sum of a window shows which elements are in it."""
    return spark.createDataFrame([(float(k), w, p, 6 - q) for k, w, p, q in zip(range(1, 6), W, (1.0, 1.25, 2.0, 3.25, 5.0), (5.0, 3.25, 2.0, 1.25, 1.0))], "pos double, w double, odd double, mirror double")


def values(df):
    return [r.value for r in df.orderBy("iter").collect()]


ROLLI = [
    (dict(n=1, align="left"), [1, 2, 4, 8, 16]), (dict(n=3, align="left"), [7, 14, 28, 24, 16]), (dict(n=6, align="left"), [31, 30, 28, 24, 16]), (dict(n=2), [3, 6, 12, 24, 16]), (dict(n=3), [3, 7, 14, 28, 24]),
    (dict(n=4), [7, 15, 30, 28, 24]), (dict(n=5), [7, 15, 31, 30, 28]), (dict(n=6), [15, 31, 31, 30, 28]), (dict(n=2, align="right"), [1, 3, 6, 12, 24]), (dict(n=5, align="right"), [1, 3, 7, 15, 31]),
    (dict(n=5, align=0), [31, 30, 28, 24, 16]), (dict(n=5, align=-4), [1, 3, 7, 15, 31]), (dict(n=5, align=-2), [7, 15, 31, 30, 28]), (dict(n=5, align=1), [30, 28, 24, 16, 0]), (dict(n=5, align=-5), [0, 1, 3, 7, 15]),
    (dict(n=3, by=2, align="left"), [7, 28, 16]), (dict(n=3, by=2), [3, 14, 24]), (dict(n=3, by=2, align="right"), [1, 7, 28]), (dict(n=2147483647, align="left"), [31, 30, 28, 24, 16]), (dict(n=0), [0, 0, 0, 0, 0]),
    (dict(n=3, partial=False), [None, 7, 14, 28, None]), (dict(n=3, align="left", partial=False), [7, 14, 28, None, None]), (dict(n=9, align=20), [0, 0, 0, 0, 0]),
]


@pytest.mark.parametrize("given,want", ROLLI)
def test_windows_of_rows(bits, given, want):
    given = {"partial": True} | given
    assert values(rolli_exec(SUM, bits, "w", order="pos", **given)) == want
    assert values(rolli_exec(SUM, bits, "w", order="pos", lowering="arrays", **given)) == want


@pytest.mark.parametrize("widths,want", [((3, 1, 3, 1, 3), [7, 2, 28, 8, 16]), ((3, 1, 0, 1, 3), [7, 2, 0, 8, 16])])
def test_windows_of_rows_with_own_widths(spark, widths, want):
    df = spark.createDataFrame([(k, w, n) for k, (w, n) in enumerate(zip(W, widths))], "pos int, w double, n int")
    assert values(rolli_exec(SUM, df, "w", "n", align="left", partial=True, order="pos")) == want


ROLLBY = [
    (dict(width=1, by=1), [1, 2, 4, 8, 16]), (dict(width=1, by=1, bounds="[]"), [3, 6, 12, 24, 16]), (dict(width=1, by=1, bounds="(]"), [2, 4, 8, 16, 0]), (dict(width=1, by=1, bounds="()"), [0, 0, 0, 0, 0]),
    (dict(width=0.999, by=1, bounds="[]"), [1, 2, 4, 8, 16]), (dict(width=1, by=1.001, bounds="()"), [0, 4, 8, 16]), (dict(width=1, by=0.999, bounds="()"), [0, 2, 4, 8, 16]), (dict(width=0, by=1), [0, 0, 0, 0, 0]), (dict(width=0, by=1, bounds="[]"), [1, 2, 4, 8, 16]),
    (dict(width=2, by=1, bounds="()"), [2, 4, 8, 16, 0]), (dict(width=1, by=1, offset=-1), [0, 1, 2, 4, 8]), (dict(width=1, by=1, offset=-1, bounds="(]"), [1, 2, 4, 8, 16]), (dict(width=1, by=1, offset=-2), [0, 0, 1, 2, 4]), (dict(width=1, by=1, offset=1), [2, 4, 8, 16, 0]), (dict(width=1, by=1, offset=-5), [0] * 5),
    (dict(width=1, by=1, start=2), [2, 4, 8, 16]), (dict(width=1, by=1, end=4), [1, 2, 4, 8]), (dict(width=1, by=1, start=2, end=4), [2, 4, 8]), (dict(width=2, by=2), [3, 12, 16]),
    (dict(width=1, by=1, position="odd"), [3, 4, 8, 0, 16]), (dict(width=1, by=1, position="mirror"), [1, 2, 0, 12, 16]), (dict(width=1, by=1, start=1.001), [2, 4, 8, 16]), (dict(width=1, by=50, start=-100, end=100), [0] * 5),
]


@pytest.mark.parametrize("given,want", ROLLBY)
def test_windows_by_position(bits, given, want):
    given = {"position": "pos"} | given
    assert values(rollby_exec(SUM, bits, "w", **given)) == want


def test_windows_at_and_between(bits):
    at = lambda points, **k: values(rollat_exec(SUM, bits, "w", at=points, position="pos", **k))
    assert at((1, 5), width=4, offset=-2) == [3, 28] and at((1, 5), width=4, offset=-2, bounds="(]") == [7, 24]
    assert at((1, 3, 5), width=1) == [1, 4, 16] and at((1.001, 3.001, 5.001), width=1) == [2, 8, 0]
    assert at((5, 1), width=4, offset=-2) == [28, 3]
    assert at(None, width=1) == [1, 2, 4, 8, 16]
    between = lambda left, right, **k: values(rollbw_exec(SUM, bits, "w", left, right, position="pos", **k))
    assert between([1] * 5, range(1, 6)) == [0, 1, 3, 7, 15] and between([1] * 5, range(1, 6), bounds="[]") == [1, 3, 7, 15, 31]
    assert between(range(1, 6), [5] * 5) == [15, 14, 12, 8, 0]
    assert between([float("-inf"), 2], [float("inf"), 1]) == [31, 0]
    assert between([], []) == []
    assert values(rollby_exec(SUM, bits, "w", 2, 2, order="pos")) == [3, 12, 16]


def test_empty_windows_run_on_no_elements(bits):
    ends = ([10.0], [11.0])
    for text, want in (("sum(x)", 0.0), ("length(x)", 0), ("all(x > 0)", True), ("any(x > 0)", False), ("sum(c(x, 1))", 1.0)):
        assert rollbw_exec(stat(text), bits, "w", *ends, position="pos").first().value == want
    assert math.isnan(rollbw_exec(stat("mean(x)"), bits, "w", *ends, position="pos").first().value)
    assert math.isnan(rollbw_exec(stat("sum(mean(x) * x) / 0"), bits, "w", *ends, position="pos").first().value)
    assert rollby_exec(SUM, bits.limit(0), "w", 1, 1, position="pos").count() == 0
    assert rollby_exec(SUM, bits.limit(0), "w", 1, 1, position="pos", start=1, end=2).count() == 2
    assert rolli_exec(SUM, bits.limit(0), "w", 2, order="pos").count() == 0


def test_runners_agree(spark):
    """By rows, by position, at positions and between ends, on one regular series."""
    g = random.Random(8)
    x = [g.random() for _ in range(300)]
    df = spark.createDataFrame([(k, v, v * v + g.random()) for k, v in enumerate(x, 1)], "pos int, x double, y double").repartition(4)
    s = stat(SLOPE)
    want = [s(*zip(*((r.x, r.y) for r in df.orderBy("pos").collect()[k : k + 20])))[0] for k in range(300)]
    rolled = [
        values(rolli_exec(s, df, ["x", "y"], 20, align="left", partial=True, order="pos")),
        values(rollby_exec(s, df, ["x", "y"], 20, 1, position="pos")),
        values(rollat_exec(s, df, ["x", "y"], 20, position="pos")),
        values(rollbw_exec(s, df, ["x", "y"], range(1, 301), range(21, 321), position="pos")),
        values(rollby_exec(s, df, ["x", "y"], 20, 1, position="pos", lowering="arrays")),
    ]
    assert all(same(r, want) for r in rolled)
    big = values(rolli_exec(stat("sum(x * y) / length(x)"), df, ["x", "y"], 50, order="pos"))
    pairs = [(r.x, r.y) for r in df.orderBy("pos").collect()]
    assert all(same(v, None if k < 24 or k + 25 >= 300 else sum(a * b for a, b in pairs[k - 24 : k + 26]) / 50) for k, v in enumerate(big))


def test_times_as_positions(spark):
    df = spark.sql("SELECT timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS ts, id * 1.0D AS x FROM range(48)")
    out = rollby_exec(stat("length(x)"), df, ["x"], 86400e6, 86400e6, position="ts")
    assert values(out) == [24, 24]
    assert out.first().left == 1704067200000000.0


def test_traced_statistics_run(df, rows):
    s = stat(lambda x, *more: fn.sum(x, *more, na_rm=True))
    got = dict(group_exec(s, df, {"x": "x", 0: "y"}, "g").collect())
    assert same([got[12]], [sum(r[2] + r[3] for r in rows if r[1] == 12)])


def test_plans(df):
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    p = plan(group_exec(stat(SLOPE), df, ["x", "y"], "g"))
    assert "Window" not in p and "Python" not in p and "Cartesian" not in p and p.count("partial_sum") >= 4
    p = plan(rollby_exec(SUM, df, ["x"], 10, 5, position="k"))
    assert "NestedLoop" not in p and "Cartesian" not in p and "partial_sum" in p
    p = plan(rolli_exec(SUM, df, ["x"], 10, order="k"))
    assert "SinglePartition" not in p and "Python" not in p


@pytest.mark.parametrize("source", ["sum(x)", "mean(x)", "mean(x, na.rm = TRUE)", "sum(x, na.rm = TRUE) + length(x)", "any(x > 0.9)", "all(x > 0.1, na.rm = TRUE)", "sum(x * x) - sum(x) / 2"])
def test_windows_made_of_steps(spark, source):
    """Windows that are several steps wide add up steps; they equal those that gather their rows."""
    g = random.Random(11)
    rows = [(g.choice([k, k + 0.5, k + 100 * (k > 60)]) * 1.0, None if g.random() < 0.05 else g.random()) for k in range(120)]
    df = spark.createDataFrame(rows, "p double, x double").repartition(4)
    for given in (dict(width=12, by=3, start=0), dict(width=4, by=4, offset=-8, start=0), dict(width=30, by=2, start=-50, end=400), dict(width=0, by=2, start=1)):
        plans = [rollby_exec(stat(source), df, ["x"], position="p", lowering=how, **given) for how in ("auto", "arrays")]
        assert given["width"] == 0 or "Join" not in plans[0]._jdf.queryExecution().executedPlan().toString()
        assert same(*map(values, plans)), given


@pytest.mark.parametrize("source", ["sum(x)", "mean(x)", "length(x) + sum(x, na.rm = TRUE)", "any(x > 0.99)", "all(x > 0.01, na.rm = TRUE)"])
def test_wide_windows_of_rows(spark, source):
    """Windows put together from running sums equal those that are gone through."""
    g = random.Random(12)
    x = [None if g.random() < 0.002 else g.random() for _ in range(700)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double").repartition(4)
    s = stat(source)
    for n, align, partial in ((64, "center", True), (100, "left", False), (200, "right", True), (699, "center", True), (70, 30, True), (80, -200, True)):
        first = align if isinstance(align, int) else {"left": 0, "center": int((1 - n) / 2), "right": 1 - n}[align]
        want = [s(x[max(k + first, 0) : max(k + first + n, 0)])[0] if partial or 0 <= k + first <= 700 - n else None for k in range(700)]
        assert same(values(rolli_exec(s, df, "x", n, align=align, partial=partial, order="k")), want), (n, align)
