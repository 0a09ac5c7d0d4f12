"""The language evaluated on plain lists, on the driver.

It gives the values of iteration-constant expressions, and is what the Spark plans are
checked against. A vector is a list of numbers or bools, with None for NA.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable

from iterix.plans.tree import Call, Const, Name, Node, StatError

Vector = list


def missing(x: object) -> bool:
    return x is None or (isinstance(x, float) and math.isnan(x))


def recycle(*vectors: Vector) -> list[tuple]:
    n = 0 if any(not v for v in vectors) else max(map(len, vectors))
    if n and any(n % len(v) for v in vectors):
        warnings.warn("a longer vector's length is not a multiple of a shorter one's", stacklevel=2)
    return [tuple(v[k % len(v)] for v in vectors) for k in range(n)]


def divide(a: float | None, b: float | None) -> float | None:
    if a is None or b is None:
        return None
    if b == 0:
        return float("nan") if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)
    return a / b


def power(a: float | None, b: float | None) -> float | None:
    if b == 0 or a == 1:
        return 1.0
    if a is None or b is None:
        return None
    try:
        return math.pow(a, b)
    except OverflowError:
        return -math.inf if a < 0 and b % 2 == 1 else math.inf
    except ValueError:
        if a == 0:
            return math.copysign(math.inf, a) if b % 2 == 1 else math.inf
        return float("nan")


def _number(f: Callable) -> Callable:
    def op(a, b):
        if a is None or b is None:
            return None
        out = f(a, b)
        return float(out) if isinstance(out, float) else out

    return op


def _compare(f: Callable) -> Callable:
    return lambda a, b: None if missing(a) or missing(b) else f(a, b)


def truth(a: object) -> bool | None:
    return None if missing(a) else a != 0


def both(a: object, b: object) -> bool | None:
    a, b = truth(a), truth(b)
    return False if a is False or b is False else None if a is None or b is None else True


def either(a: object, b: object) -> bool | None:
    a, b = truth(a), truth(b)
    return True if a is True or b is True else None if a is None or b is None else False


ELEMENTWISE: dict[str, Callable] = {
    "+": _number(lambda a, b: a + b),
    "-": _number(lambda a, b: a - b),
    "*": _number(lambda a, b: a * b),
    "/": divide,
    "^": power,
    ">": _compare(lambda a, b: a > b),
    ">=": _compare(lambda a, b: a >= b),
    "<": _compare(lambda a, b: a < b),
    "<=": _compare(lambda a, b: a <= b),
    "==": _compare(lambda a, b: a == b),
    "!=": _compare(lambda a, b: a != b),
    "&": both,
    "|": either,
}


def _total(v: Vector, na_rm: bool) -> float | int | None:
    if na_rm:
        v = [x for x in v if not missing(x)]
    if any(x is None for x in v):
        return None
    if any(isinstance(x, float) and not math.isfinite(x) for x in v):
        return sum(map(float, v))
    try:
        return math.fsum(v) if any(isinstance(x, float) for x in v) else sum(map(int, v))
    except OverflowError:
        return sum(map(float, v))


def _mean(v: Vector, na_rm: bool) -> float | None:
    if na_rm:
        v = [x for x in v if not missing(x)]
    if not v:
        return float("nan")
    total = _total(v, False)
    if total is None:
        return None
    if math.isinf(total) and all(math.isfinite(x) for x in v):
        return math.fsum(x / len(v) for x in v)
    return total / len(v)


def _fold(v: Vector, na_rm: bool, decides: bool) -> bool | None:
    seen = [truth(x) for x in v]
    if decides in seen:
        return decides
    return None if None in seen and not na_rm else not decides


def index(i: object, n: int) -> int | None:
    """The place of an index, None if it is missing or beyond the end."""
    if missing(i) or math.isinf(i) and i > 0:
        return None
    if i < 1:
        raise StatError("only strictly positive indices are supported")
    return int(i) - 1 if i < n + 1 else None


def _subassign(x: Vector, s: Vector, y: Vector) -> Vector:
    x = list(x)
    for k, i in enumerate(s):
        at = index(i, len(x))
        if at is None:
            raise StatError("an index to assign to is missing or beyond the end")
        if not y:
            raise StatError("nothing to assign")
        x[at] = y[k % len(y)]
    return x


def whole(x: object, what: str) -> int:
    if missing(x) or x < 0 or math.isinf(x):
        raise StatError(f"`{what}` must be a number of 0 or more")
    return int(x)


def _rep(x: Vector, times: Vector, length_out: Vector, each: Vector) -> Vector:
    each_n = 1 if not each or missing(each[0]) else whole(each[0], "each")
    out = [v for v in x for _ in range(each_n)]
    if length_out and not missing(length_out[0]):
        n = whole(length_out[0], "length.out")
        return [out[k % len(out)] if out else None for k in range(n)]
    if len(times) == 1:
        return out * whole(times[0], "times")
    if len(times) != len(out):
        raise StatError("`times` must have one element, or one for each element of `x`")
    return [v for v, n in zip(out, times) for _ in range(whole(n, "times"))]


class Local:
    """Evaluates trees with names bound to vectors. functions: other functions that constants may call."""

    def __init__(self, names: dict[str, Vector], functions: dict[str, Callable] | None = None):
        self.names, self.functions = dict(names), functions or {}

    def __call__(self, node: Node) -> Vector:
        if isinstance(node, Const):
            return list(node.value) if isinstance(node.value, tuple) else [node.value]
        if isinstance(node, Name):
            if node.id not in self.names:
                raise StatError(f"`{node.id}` is not found")
            return self.names[node.id]
        return self.call(node)

    def condition(self, node: Node) -> bool:
        v = self(node)
        if len(v) != 1:
            raise StatError("a condition must have one element")
        if missing(v[0]):
            raise StatError("a condition must not be missing")
        return v[0] != 0

    def call(self, node: Call) -> Vector:
        fn, a = node.fn, node.args
        if fn in ("<-", "="):
            self.names[a[0].id] = out = self(a[1])
            return out
        if fn == "{":
            out: Vector = []
            for x in a:
                out = self(x)
            return out
        if fn == "if":
            return self(a[1]) if self.condition(a[0]) else self(a[2]) if len(a) > 2 else []
        if fn == "for":
            over = self(a[1])
            self.names[a[0].id] = [None]
            for v in over:
                self.names[a[0].id] = [v]
                self(a[2])
            return []
        named = {n: self(x) for n, x in zip(node.names, a) if n}
        values = [self(x) for n, x in zip(node.names, a) if not n]
        na_rm = bool(named.get("na.rm", [False])[0])
        if fn in ELEMENTWISE:
            return [ELEMENTWISE[fn](x, y) for x, y in recycle(*values)]
        if fn in ("&&", "||"):
            if any(len(v) > 1 for v in values):
                raise StatError(f"`{fn}` takes single values")
            x, y = (v[0] if v else None for v in values)
            return [both(x, y) if fn == "&&" else either(x, y)]
        if fn == "sum":
            totals = [_total(v, na_rm) for v in values]
            return [None if None in totals else sum(totals)]
        if fn in ("mean", "mean1"):
            return [_mean(values[0], na_rm)]
        if fn == "length":
            return [len(values[0])]
        if fn in ("all", "any"):
            return [_fold([x for v in values for x in v], na_rm, fn == "any")]
        if fn == "uplus":
            return [int(x) if fn == "uplus" and isinstance(x, bool) else x for x in values[0]]
        if fn == "uminus":
            return [None if x is None else -x for x in values[0]]
        if fn == "!":
            return [None if missing(x) else x == 0 for x in values[0]]
        if fn == "square":
            return [None if x is None else float(x) * float(x) for x in values[0]]
        if fn == "ifelse":
            test, yes, no = values
            pick = lambda v, k: v[k % len(v)] if v else None
            return [None if missing(t) else pick(yes, k) if t != 0 else pick(no, k) for k, t in enumerate(test)]
        if fn == "seq_along":
            return list(range(1, len(values[0]) + 1))
        if fn == "[":
            at = [index(i, len(values[0])) for i in values[1]]
            return [None if k is None else values[0][k] for k in at]
        if fn == "subassign":
            return _subassign(*values)
        if fn == "c":
            return [x for v in values for x in v]
        if fn == "rep":
            return _rep(values[0], named["times"], named["length.out"], named["each"])
        if fn == "numeric":
            return [0.0] * whole(named["length"][0], "length")
        if fn == "numeric_along":
            return [0.0] * len(values[0])
        if fn == "numeric_alongn":
            return [0.0] * math.prod(map(len, values))
        if fn not in self.functions:
            raise StatError(f"`{fn}` is not supported")
        plain = lambda v: v[0] if len(v) == 1 else v
        out = self.functions[fn](*map(plain, values), **{n.replace(".", "_"): plain(v) for n, v in named.items()})
        return as_vector(out)


def as_vector(x: object) -> Vector:
    """A value of the caller's as a vector."""
    if isinstance(x, (bool, int, float)) or x is None:
        return [x]
    if hasattr(x, "tolist"):
        x = x.tolist()
        return x if isinstance(x, list) else [x]
    return [v.item() if hasattr(v, "item") else v for v in x]
