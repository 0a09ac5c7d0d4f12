import math

import pytest

from iterix import StatError, fn, reuse_calls, stat
from iterix.plans.compile import bind
from iterix.plans.local import Local
from iterix.plans.parse import parse
from iterix.plans.tree import free_names, show

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    "text",
    ["-x^2", "(-x)^2", "2^-1^2", "!x & y | z", "a <- b <- 3", "x[2]^2", "if (a) 1 else if (b) 2 else 3", "{\n    a <- 1\n    for (i in x) {\n        a <- a + i\n    }\n    a\n}", "sum(x, na.rm = TRUE) - (a - b)", "a / (b * c) / d", "x[i + 1]", "-(-3)", "c(1L, 2.5, NA, NaN, -Inf)"],
)
def test_text_survives_a_round_trip(text):
    tree = parse(text)
    assert parse(show(tree)) == tree


def test_precedence():
    local = lambda t: stat(t, ["x"])([0.0])
    assert local("-2^2") == [-4] and local("2^3^2") == [512] and local("1 + 2 * 3 == 7 && !FALSE") == [True]
    assert local("7 - 2 - 1") == [4] and local("2 / 2 / 2") == [0.5]


def test_newlines_and_separators():
    assert show(parse("{a <- 1; b <- 2\n\n # remark\n a +\n b}")) == "{\n    a <- 1\n    b <- 2\n    a + b\n}"
    assert show(parse("{ if (a) 1\n else 2 }")) == "{\n    if (a) 1 else 2\n}"
    assert parse("sum(\n x,\n y)") == parse("sum(x, y)")


@pytest.mark.parametrize("text", ["", "x +", "x[1", "{ x", "while (TRUE) x", "repeat x", "1 < 2 < 3", "f(x", "x $ y", "dplyr::mean(x)", "function(x) x"])
def test_bad_text(text):
    with pytest.raises(StatError):
        parse(text)


@pytest.mark.parametrize(
    "text", ["median(x)", "sum(a <- x)", "mean(x, trim = 0.1)", "mean(x, y, z, w)", "ifelse(x, 1)", "length(y = x)", "c(x)[1] <- 2", "x[1, 2] <- 3", "x %% 2", "vapply(x)", "mean()"]
)
def test_what_the_language_refuses(text):
    with pytest.raises(StatError):
        stat(text, ["x", "y", "z", "w"])


def test_parameters():
    assert stat("sum(y * x) / mean(y)").params == ("y", "x")
    assert stat("{ a <- x; a + b }").params == ("x", "b")
    assert free_names(parse("{ for (i in x) a <- i; a + i }")) == ["x"]
    with pytest.raises(StatError):
        stat("1 + 2")
    with pytest.raises(StatError):
        stat("x + y")([1.0])
    with pytest.raises(StatError):
        stat("x")([1.0], [2.0])
    assert stat("x - y")([5.0], x=[7.0]) == [2.0]
    assert stat("x * k", ["x", "k"], defaults={"k": 3})([2.0]) == [6.0]
    assert stat("sum(..., 1)", ["..."])([1.0], [2.0]) == [4.0]
    assert stat("..2 - ..1", ["..."])([1.0], [5.0]) == [4.0]


def test_traced_functions():
    s = stat(lambda x, y=2.0: fn.ifelse((x > 1) & ~(x == 3), x**2, -x) / y + x[1])
    assert s([1.0, 2.0, 3.0]) == [0.5, 3.0, -0.5]
    with pytest.raises(StatError):
        stat(lambda x: 1.0 if x > 2 else 0.0)


def test_constant_expressions():
    s = stat("sum(x) * scale(w)", ["x"], env={"scale": lambda v: v * 10, "w": 2.0})
    assert s([1.0, 2.0]) == [60.0]
    with pytest.raises(StatError):
        stat("scale(x)", ["x"], env={"scale": abs})([1.0])
    with pytest.raises(StatError):
        stat("{ y <- 1 + 1; x * scale(y) }", ["x"], env={"scale": abs})([1.0])
    with pytest.raises(StatError):
        stat("sum(x, na.rm = x)")([1.0])
    with pytest.raises(StatError):
        stat("sum(x, na.rm = NA)")([1.0])


@pytest.mark.parametrize(
    "text", ["mean(x) + mean(x)", "{ a <- x * 2; b <- x * 2; x <- a; c(sum(x * 2), sum(x * 2), b) }", "sum((x - mean(x))^2) / sum((x - mean(x)))", "{ y <- mean(x); x <- x - mean(x); mean(x) + y }"]
)
def test_reused_calls_change_nothing(text):
    plain = stat(text, ["x"], optimize=False)
    again = reuse_calls(plain.processed)
    x = [1.0, 4.0, 9.0]
    assert Local({"x": x})(again) == Local({"x": x})(plain.processed) == stat(text, ["x"])(x)


def test_reused_calls_are_named_once():
    assert stat("sum((x - mean(x)) * (x - mean(x)))").code().count("mean(") == 1
    assert stat("sum(x)").code(raw=True) == "sum(x)"


@pytest.mark.parametrize(
    "text,want",
    [
        ("sum(x)", [None]), ("sum(x, na.rm = TRUE)", [6.0]), ("mean(x, na.rm = TRUE)", [2.0]), ("length(x)", [4]),
        ("x[c(1, 9, NA)]", [1.0, None, None]), ("x[2.9]", [None]), ("rep(c(1, 2), each = 2, times = 2)", [1, 1, 2, 2, 1, 1, 2, 2]),
        ("rep(c(1, 2), times = c(0, 3))", [2, 2, 2]), ("rep(c(1, 2), length.out = 3)", [1, 2, 1]), ("NA^0", [1.0]), ("1^NA", [1.0]), ("1 / 0", [INF]), ("-1 / 0", [-INF]),
        ("NA & FALSE", [False]), ("NA | TRUE", [True]), ("NA && TRUE", [None]), ("any(NA, FALSE)", [None]), ("all(NA, FALSE)", [False]), ("all()", [True]), ("any()", [False]),
        ("ifelse(c(TRUE, NA, FALSE), 1, c(2, 3))", [1, None, 2]), ("c(1, 2, 3) + c(10, 20)", [11, 22, 13]), ("c(1, 2) + numeric(0)", []), ("seq_along(x)", [1, 2, 3, 4]),
        ("{ y <- x; y[c(2, 2)] <- c(5, 6); y }", [1.0, 6.0, 2.0, 3.0]), ("if (FALSE) 1", []), ("for (i in x) i", []), ("numeric_alongn(x, x)", [0.0] * 16), ("uminus(TRUE)", [-1]),
    ],
)
def test_values_on_the_driver(text, want):
    want = [pytest.approx(w) if isinstance(w, float) and math.isfinite(w) else w for w in want]
    assert stat(text, ["x"])([1.0, None, 2.0, 3.0]) == want


@pytest.mark.parametrize("text", ["x[0]", "x[-1]", "{ x[9] <- 1; x }", "{ x[NA] <- 1; x }", "if (x > 1) 1", "if (NA) 1", "x && TRUE", "rep(x, times = c(1, 2))", "numeric(-1)"])
def test_errors_on_the_driver(text):
    with pytest.raises(StatError):
        stat(text, ["x"])([1.0, 2.0, 3.0])


def test_golden_loops():
    fibonacci = "{ a <- 0; b <- 1; for (i in x) { t <- a + b; a <- b; b <- t }; b }"
    assert stat(fibonacci, ["x"])([1.0] * 10) == [89.0]
    convolve = "{ z <- numeric(length(a) + length(b) - 1); for (i in seq_along(a)) for (j in seq_along(b)) z[i + j - 1] <- z[i + j - 1] + a[i] * b[j]; z }"
    b = bind(stat(convolve, ["a", "b"], env={}), {}, {"a": [0.5, 1, 1.5], "b": [0.75, 2, 1 / 3]})
    assert b.local({}) == pytest.approx([0.375, 1.75, 3.291667, 3.333333, 0.5], abs=1e-6)
