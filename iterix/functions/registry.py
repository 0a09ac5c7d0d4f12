"""What each function of the language takes and returns.

size: how long the result is, given its arguments.
  one        a single value
  same       as long as the argument named by `of`
  recycled   as the longest argument, 0 if any is empty
  other      known only when it runs, or by a rule of its own
kind: the type of the result (logical < integer < double).
  double, logical, integer    always that
  number     integer if all arguments are logical or integer, else double
  widest     the widest of the arguments named by `of` (of all, if none is named)
  last       of the last argument
`constant` arguments must be the same for all iterations. `rows` functions can be
computed row by row or as aggregates, without holding an iteration's vector.
"""

from __future__ import annotations

from dataclasses import dataclass

NA = None
_REQUIRED = object()


@dataclass(frozen=True)
class Function:
    name: str
    params: tuple[str, ...]
    size: str
    kind: str
    of: tuple[str, ...] = ()
    defaults: tuple[tuple[str, object], ...] = ()
    constant: tuple[str, ...] = ()
    rows: bool = True
    aggregate: bool = False


def _all() -> dict[str, Function]:
    na_rm = {"defaults": (("na.rm", False),), "constant": ("na.rm",)}
    binary = ("e1", "e2")
    found = [
        Function("sum", ("...", "na.rm"), "one", "number", aggregate=True, **na_rm),
        Function("mean", ("x", "na.rm", "trim"), "one", "double", defaults=(("na.rm", False), ("trim", 0.0)), constant=("na.rm", "trim"), aggregate=True),
        Function("mean1", ("x", "na.rm"), "one", "double", aggregate=True, **na_rm),
        Function("length", ("x",), "one", "integer", aggregate=True),
        Function("all", ("...", "na.rm"), "one", "logical", aggregate=True, **na_rm),
        Function("any", ("...", "na.rm"), "one", "logical", aggregate=True, **na_rm),
        *(Function(op, binary, "recycled", "number") for op in "+-*"),
        Function("/", binary, "recycled", "double"),
        Function("^", binary, "recycled", "double"),
        *(Function(op, binary, "recycled", "logical") for op in (">", ">=", "<", "<=", "==", "!=", "&", "|")),
        *(Function(op, binary, "one", "logical") for op in ("&&", "||")),
        Function("uplus", ("x",), "same", "number", of=("x",)),
        Function("uminus", ("x",), "same", "number", of=("x",)),
        Function("!", ("x",), "same", "logical", of=("x",)),
        Function("square", ("x",), "same", "double", of=("x",)),
        Function("ifelse", ("test", "yes", "no"), "same", "widest", of=("test",)),
        Function("seq_along", ("along.with",), "same", "integer", of=("along.with",)),
        Function("[", ("x", "i"), "same", "widest", of=("i",), rows=False),
        Function("subassign", ("x", "s", "y"), "same", "widest", of=("x",), rows=False),
        Function("c", ("...",), "other", "widest", rows=False),
        Function("rep", ("x", "times", "length.out", "each"), "other", "widest", of=("x",), defaults=(("times", 1.0), ("length.out", NA), ("each", 1.0)), constant=("times", "length.out", "each"), rows=False),
        Function("numeric", ("length",), "other", "double", defaults=(("length", 0.0),), constant=("length",), rows=False),
        Function("numeric_along", ("along.with",), "same", "double", of=("along.with",), rows=False),
        Function("numeric_alongn", ("...",), "other", "double", rows=False),
        Function("<-", ("name", "value"), "same", "last", of=("value",)),
        Function("{", ("...",), "other", "last"),
        Function("if", ("test", "yes", "no"), "other", "widest"),
        Function("for", ("var", "over", "body"), "other", "last", rows=False),
    ]
    return {f.name: f for f in found}


FUNCTIONS = _all()
#: The language's second spelling of an assignment.
FUNCTIONS["="] = FUNCTIONS["<-"]
KINDS = ("logical", "integer", "double")


def required(f: Function) -> list[str]:
    given = {k for k, _ in f.defaults}
    return [p for p in f.params if p != "..." and p not in given and not (f.name == "if" and p == "no")]


def widest(kinds: list[str]) -> str:
    return max(kinds, key=KINDS.index, default="double")


def result_kind(f: Function, kinds: dict[str, str], values: list[str]) -> str:
    """The result's type. kinds: by parameter; values: of all arguments that are data, in order."""
    if f.kind == "number":
        return "double" if "double" in values else "integer"
    if f.kind == "widest":
        by = {"[": ("x",), "subassign": ("x", "y"), "rep": ("x",), "ifelse": ("yes", "no")}.get(f.name)
        return widest([kinds[p] for p in by] if by else values)
    if f.kind == "last":
        return values[-1] if values else "double"
    return f.kind
