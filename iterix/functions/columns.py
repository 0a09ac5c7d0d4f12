"""The language's arithmetic, comparisons and aggregates as Spark columns.

NA is NULL and NaN is NaN; arithmetic propagates both, comparisons and logic take
both as missing. Spark differs in places (0 divisors raise, NaN equals itself,
aggregates skip NULL); every difference is settled here and nowhere else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

NAN = float("nan")


@dataclass(frozen=True)
class Value:
    """A column that holds doubles, or booleans if it is logical. nan: it may be NaN."""

    col: Column
    logical: bool = False
    nan: bool = True


def number(v: Value) -> Column:
    return v.col.cast("double") if v.logical else v.col


def truth(v: Value) -> Column:
    """True, false, or NULL if missing."""
    if v.logical:
        return v.col
    return F.when(~F.isnan(v.col), v.col != 0) if v.nan else v.col != 0


def known(v: Value) -> Column:
    """The value, NULL if it is NaN."""
    return F.when(~F.isnan(v.col), v.col) if v.nan and not v.logical else v.col


def divide(a: Column, b: Column) -> Column:
    # pow gives the infinity of the divisor's sign; 0 times it is NaN
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def power(a: Column, b: Column) -> Column:
    one = F.lit(1.0)
    return F.when(b.eqNullSafe(F.lit(0.0)), one).when(a.eqNullSafe(one), one).otherwise(F.pow(a, b))


_COMPARE = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}


def binary(fn: str, a: Value, b: Value) -> Value:
    if fn in _COMPARE:
        x, y = (known(Value(number(v), nan=v.nan and not v.logical)) for v in (a, b))
        return Value(_COMPARE[fn](x, y), logical=True, nan=False)
    if fn in ("&", "&&"):
        return Value(truth(a) & truth(b), logical=True, nan=False)
    if fn in ("|", "||"):
        return Value(truth(a) | truth(b), logical=True, nan=False)
    x, y = number(a), number(b)
    return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: divide(x, y), "^": lambda: power(x, y)}[fn]())


def unary(fn: str, a: Value) -> Value:
    if fn == "!":
        return Value(~truth(a), logical=True, nan=False)
    x = number(a)
    return Value({"uplus": lambda: x, "uminus": lambda: -x, "square": lambda: x * x}[fn](), nan=a.nan)


def choose(test: Value, yes: Value, no: Value) -> Value:
    """ifelse: a missing test gives NA."""
    logical = yes.logical and no.logical
    y, n = (v.col if logical else number(v) for v in (yes, no))
    t = truth(test)
    return Value(F.when(t, y).when(~t, n), logical, yes.nan or no.nan)


def branch(test: Value, yes: Value, no: Value) -> Value:
    """if: a missing test is an error."""
    logical = yes.logical and no.logical
    y, n = (v.col if logical else number(v) for v in (yes, no))
    t = truth(test)
    stop = F.raise_error(F.lit("a condition must not be missing")).cast("boolean" if logical else "double")
    return Value(F.when(t.isNull(), stop).when(t, y).otherwise(n), logical, yes.nan or no.nan)


_SCALE = 2.0**64


Measure = Callable[[str, Column], Column]


def measured(kind: str, c: Column) -> Column:
    """The three aggregates that all others are made of: count, sum, max."""
    return {"count": F.count, "sum": F.sum, "max": F.max}[kind](c)


def over(frame: WindowSpec) -> Measure:
    return lambda kind, c: measured(kind, c).over(frame)


def aggregate(fn: str, v: Value | None, na_rm: bool, present: Column | None = None, measure: Measure = measured) -> Value:
    """An aggregate over what measure measures: the rows of an iteration, or of a frame. present: false on rows that stand for an empty one."""
    n = measure("count", F.lit(1) if present is None else F.when(present, F.lit(1)))
    if fn == "length":
        return Value(n.cast("double"), nan=False)
    x = truth(v) if fn in ("all", "any") else known(Value(number(v), nan=v.nan and not v.logical)) if na_rm else number(v)
    if present is not None:
        x = F.when(present, x)
    there = measure("count", x)
    if fn in ("all", "any"):
        decides = F.coalesce(measure("max", ~x if fn == "all" else x), F.lit(False))
        out = F.when(decides, F.lit(fn == "any"))
        if not na_rm:
            out = out.when(there < n, F.lit(None).cast("boolean"))
        return Value(out.otherwise(F.lit(fn == "all")), logical=True, nan=False)
    total = F.coalesce(measure("sum", x), F.lit(0.0))
    if fn == "mean":
        # a sum beyond the largest double can still have a mean
        large = (F.abs(total) == float("inf")) & (there > 0)
        out = F.when(there == 0, F.lit(NAN)).otherwise(F.when(large, measure("sum", x / _SCALE) / there * _SCALE).otherwise(total / there))
    elif fn == "mean1":
        out = F.when(there == 0, F.lit(NAN)).otherwise(total / there)
    else:
        out = total
    return Value(out if na_rm else F.when(there == n, out))


def alone(fn: str, v: Value, na_rm: bool) -> Value:
    """An aggregate of a single value."""
    if fn == "length":
        return Value(F.lit(1.0), nan=False)
    if fn in ("all", "any"):
        return Value(F.coalesce(truth(v), F.lit(fn == "all")) if na_rm else truth(v), logical=True, nan=False)
    x = number(v)
    if not na_rm:
        return Value(x, nan=v.nan)
    return Value(F.coalesce(known(Value(x, nan=v.nan and not v.logical)), F.lit(0.0 if fn == "sum" else NAN)))


def typed(col: Column, kind: str, logical: bool) -> Column:
    """A result as its type: double, bigint or boolean."""
    if kind == "logical":
        return col if logical else F.when(~F.isnan(col), col != 0)
    if kind == "integer":
        return F.when(~F.isnan(col.cast("double")) & (F.abs(col.cast("double")) != float("inf")), col).cast("bigint")
    return col.cast("double")
