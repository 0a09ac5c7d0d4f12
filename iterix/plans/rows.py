"""Statistics as staged aggregates: no iteration's vector is ever held.

The tree becomes terms, each a value per row or one per iteration. Equal terms are one
term, so a mean that is used twice is computed once, at any depth. Aggregates have a
level, one more than the deepest in their argument. Those inside another aggregate's
argument are computed level by level: aggregate by iteration, with partial sums before
the exchange, and join the results back to the rows. Spark broadcasts them if they are
small and splits skewed keys if not. The outermost aggregates end in one grouping.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iterix.functions import columns as C
from iterix.functions.registry import FUNCTIONS, result_kind, widest
from iterix.plans.compile import Bound
from iterix.plans.tree import Call, Const, Name, Node, StatError, assigned, walk


@dataclass(frozen=True)
class Term:
    """fn of other terms. rows: a value for each row, rather than for each iteration."""

    fn: str
    args: tuple[Term, ...] = ()
    rows: bool = False
    kind: str = "double"
    level: int = 0
    of: object = None  # a column's name, a constant, or whether missing values go
    nan: bool = field(default=True, compare=False)


class NeedsVectors(StatError):
    """The statistic has no row-by-row form after all."""


def shown(t: Term) -> str:
    """A term as text."""
    if t.fn == "column":
        return str(t.of)
    if t.fn == "constant":
        return str(t.of[2])
    if t.fn in FUNCTIONS and len(t.args) == 2 and not t.fn.isalpha():
        return f"({shown(t.args[0])} {t.fn} {shown(t.args[1])})"
    fn = {"alone": t.of[0] if isinstance(t.of, tuple) else "", "uminus": "-", "uplus": "+"}.get(t.fn, t.fn)
    return f"{fn}({', '.join(map(shown, t.args))})"


@dataclass(frozen=True)
class Unequal:
    """What a name stands for after branches that give it different lengths; using it is an error."""


def is_rowwise(bound: Bound) -> bool:
    """Whether the statistic can be computed without its vectors."""
    for n in walk(bound.tree):
        if isinstance(n, Call) and not FUNCTIONS[n.fn].rows:
            return False
        if isinstance(n, Call) and n.fn == "{" and not n.args:
            return False
        if isinstance(n, Name) and len(bound.constants.get(n.id, (0,))) != 1:
            return False
        if isinstance(n, Const) and isinstance(n.value, tuple):
            return False
    return True


def uses_order(bound: Bound) -> bool:
    return any(isinstance(n, Call) and n.fn == "seq_along" for n in walk(bound.tree))


class Terms:
    """Trees to terms."""

    def __init__(self, bound: Bound, kinds: dict[str, str]):
        self.names: dict[str, Term | Unequal] = {}
        for name, kind in kinds.items():
            self.names[name] = Term("column", rows=True, kind=kind, of=name, nan=kind == "double")
        for name, v in bound.constants.items():
            if len(v) == 1:
                self.names[name] = self.constant(v[0])

    @staticmethod
    def constant(v: object) -> Term:
        kind = "logical" if isinstance(v, bool) or v is None else "integer" if isinstance(v, int) else "double"
        return Term("constant", kind=kind, of=("constant", repr(v), v), nan=v != v)

    def build(self, node: Node) -> Term | Unequal | None:
        if isinstance(node, Const):
            return self.constant(node.value)
        if isinstance(node, Name):
            found = self.names.get(node.id)
            if found is None:
                raise StatError(f"`{node.id}` is not found")
            if isinstance(found, Unequal):
                raise StatError(f"`{node.id}` has different lengths in different branches")
            return found
        if node.fn == "{":
            out = None
            for a in node.args:
                out = self.build(a)
            return out
        if node.fn == "<-":
            value = self.value(node.args[1])
            self.names[node.args[0].id] = value
            return value
        if node.fn == "if":
            return self.branch(node)
        return self.call(node)

    def value(self, node: Node) -> Term:
        out = self.build(node)
        if not isinstance(out, Term):
            raise StatError("the branches of a condition have different lengths")
        return out

    def branch(self, node: Call) -> Term | Unequal:
        test = self.value(node.args[0])
        if test.rows:
            raise StatError("a condition must have one element")
        before = dict(self.names)
        yes = self.build(node.args[1])
        after_yes, self.names = self.names, dict(before)
        no = self.build(node.args[2]) if len(node.args) > 2 else Unequal()
        after_no = self.names
        merged = dict(before)
        for name in dict.fromkeys([n for a in node.args[1:] for n in assigned(a)]):
            a, b = after_yes.get(name), after_no.get(name)
            merged[name] = self.either(test, a, b) if a is not None and b is not None else Unequal()
        self.names = merged
        return self.either(test, yes, no)

    def either(self, test: Term, a: Term | Unequal, b: Term | Unequal) -> Term | Unequal:
        if isinstance(a, Unequal) or isinstance(b, Unequal) or a.rows != b.rows:
            return Unequal()
        if a == b:
            return a
        return Term("if", (test, a, b), a.rows, widest([a.kind, b.kind]), max(test.level, a.level, b.level), nan=a.nan or b.nan)

    def call(self, node: Call) -> Term:
        f = FUNCTIONS[node.fn]
        constants = {n: a.value for n, a in zip(node.names, node.args) if n in f.constant}
        args = [self.value(a) for n, a in zip(node.names, node.args) if n not in f.constant]
        if f.aggregate:
            return self.aggregate(node.fn, args, bool(constants.get("na.rm", False)))
        if node.fn in ("&&", "||") and any(a.rows for a in args):
            raise StatError(f"`{node.fn}` takes single values")
        kinds = dict(zip([p for p in f.params if p not in f.constant], [a.kind for a in args]))
        kind = result_kind(f, kinds, [a.kind for a in args])
        level, rows = max(a.level for a in args), any(a.rows for a in args)
        if node.fn == "seq_along":
            return Term("seq_along", (), True, "integer", 0, nan=False) if rows else self.constant(1)
        if node.fn == "ifelse" and rows and not args[0].rows:
            # as long as the test: the first of the others is needed
            raise NeedsVectors("`ifelse` of a single test and longer values needs their vectors")
        return Term(node.fn, tuple(args), rows, kind, level)

    def aggregate(self, fn: str, args: list[Term], na_rm: bool) -> Term:
        parts = []
        kind = {"length": "integer", "all": "logical", "any": "logical", "sum": "double" if any(a.kind == "double" for a in args) else "integer"}.get(fn, "double")
        for a in args:
            if a.rows:
                parts.append(Term(fn, () if fn == "length" else (a,), False, kind, 1 if fn == "length" else a.level + 1, na_rm))
            else:
                parts.append(Term("alone", (a,), False, kind, a.level, (fn, na_rm)))
        if not parts:
            return self.constant({"sum": 0, "all": True, "any": False}[fn])
        out = parts[0]
        for p in parts[1:]:
            out = Term({"sum": "+", "all": "&", "any": "|"}[fn], (out, p), False, kind, max(out.level, p.level))
        return out


def _aggregates(term: Term, inside: bool, inner: dict[Term, None], outer: dict[Term, None]) -> None:
    """Sort the aggregates below a term by whether another's argument holds them."""
    is_aggregate = term.fn in FUNCTIONS and FUNCTIONS[term.fn].aggregate
    if is_aggregate:
        (inner if inside else outer).setdefault(term)
    for a in term.args:
        _aggregates(a, inside or is_aggregate, inner, outer)


def column(term: Term, columns: dict[Term, C.Value], order: list[Column], keys: list[str]) -> C.Value:
    """A term as a column; columns: those that are there already."""
    if term in columns:
        return columns[term]
    if term.fn == "constant":
        v = term.of[2]
        if isinstance(v, bool) or v is None:
            out = C.Value(F.lit(v).cast("boolean"), logical=True, nan=False)
        else:
            out = C.Value(F.lit(float(v)), nan=v != v)
    elif term.fn == "seq_along":
        if not order:
            raise StatError("`seq_along` needs the order of the rows")
        out = C.Value(F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("double"), nan=False)
    else:
        args = [column(a, columns, order, keys) for a in term.args]
        if term.fn == "if":
            out = C.branch(*args)
        elif term.fn == "ifelse":
            out = C.choose(*args)
        elif term.fn == "alone":
            out = C.alone(term.of[0], args[0], term.of[1])
        elif len(args) == 1:
            out = C.unary(term.fn, args[0])
        else:
            out = C.binary(term.fn, *args)
    columns[term] = out
    return out


def slot(name: str) -> str:
    """The column of a parameter, quoted."""
    return f"`_p_{name}`"


def source_columns(df: DataFrame, bound: Bound) -> tuple[DataFrame, dict[str, str]]:
    """df with a column for each varying parameter, as double or boolean, and their types."""
    kinds: dict[str, str] = {}
    made: dict[str, Column] = {}
    for name, given in bound.data.items():
        col = F.col(f"`{given}`") if isinstance(given, str) else given
        kind = df.select(col.alias("v")).schema["v"].dataType.simpleString()
        if kind == "boolean":
            kinds[name], made[name] = "logical", col
        elif kind in ("tinyint", "smallint", "int", "bigint"):
            kinds[name], made[name] = "integer", col.cast("double")
        elif kind in ("float", "double") or kind.startswith("decimal"):
            kinds[name], made[name] = "double", col.cast("double")
        else:
            raise StatError(f"`{name}` must be a column of numbers or booleans, not {kind}")
    return df.withColumns({f"_p_{n}": c for n, c in made.items()}), kinds


def joined(df: DataFrame, found: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """df with the columns names of found, which has one row for each value of the keys. NULL keys are equal."""
    if not keys:  # found has one row
        return df.withColumns({n: found.select(n).scalar() for n in names})
    right = found.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *names)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return df.join(right, condition, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def lower(bound: Bound, df: DataFrame, keys: list[str], order: list[str], present: str | None, name: str) -> DataFrame:
    """keys (and order, for a value per row) and the statistic, for each value of the keys."""
    df, kinds = source_columns(df, bound)
    root = Terms(bound, kinds).value(bound.tree)
    df = df.select(*keys, *[o for o in order if o not in keys], *([present] if present else []), *[slot(n) for n in kinds])
    there = F.col(present) if present else None
    by = [F.col(o) for o in order]

    def start() -> dict[Term, C.Value]:
        return {Term("column", rows=True, kind=k, of=n): C.Value(F.col(slot(n)), k == "logical", k == "double") for n, k in kinds.items()}

    inner: dict[Term, None] = {}
    outer: dict[Term, None] = {}
    _aggregates(root, root.rows, inner, outer)
    columns = start()
    for level in sorted({t.level for t in inner}):
        made = {f"_a{level}_{k}": t for k, t in enumerate(t for t in inner if t.level == level)}
        found = df.groupBy(*keys).agg(*[_aggregate(t, columns, there, by, keys).col.alias(n) for n, t in made.items()])
        df = joined(df, found, keys, list(made))
        for n, t in made.items():
            columns[t] = C.Value(F.col(n), t.kind == "logical")
    if root.rows:
        v = column(root, columns, by, keys)
        if present:
            df = df.where(there)
        return df.select(*keys, *[o for o in order if o not in keys], C.typed(v.col, root.kind, v.logical).alias(name))
    final: dict[Term, C.Value] = {}
    made_columns = []
    for k, t in enumerate(dict.fromkeys([*outer, *(t for t in inner if t not in outer and _reaches(root, t))])):
        c = F.first(columns[t].col) if t in inner else _aggregate(t, columns, there, by, keys).col
        made_columns.append(c.alias(f"_o{k}"))
        final[t] = C.Value(F.col(f"_o{k}"), t.kind == "logical")
    grouped = df.groupBy(*keys).agg(*made_columns) if made_columns else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_o"))
    v = column(root, final, by, keys)
    return grouped.select(*keys, C.typed(v.col, root.kind, v.logical).alias(name))


def _reaches(term: Term, wanted: Term) -> bool:
    """Whether a term uses an aggregate outside other aggregates."""
    if term == wanted:
        return True
    if term.fn in FUNCTIONS and FUNCTIONS[term.fn].aggregate:
        return False
    return any(_reaches(a, wanted) for a in term.args)


def _aggregate(t: Term, columns: dict[Term, C.Value], present: Column | None, order: list[Column], keys: list[str]) -> C.Value:
    v = column(t.args[0], dict(columns), order, keys) if t.args else None
    return C.aggregate(t.fn, v, bool(t.of), present)


def measured_by(bound: Bound, kinds: dict[str, str], measure: C.Measure) -> Column | None:
    """The statistic of what measure measures, or None if it isn't one value of plain aggregates."""
    try:
        root = Terms(bound, kinds).value(bound.tree)
    except NeedsVectors:
        return None
    inner: dict[Term, None] = {}
    outer: dict[Term, None] = {}
    _aggregates(root, False, inner, outer)
    if root.rows or inner or any(_numbered(t) for t in outer):
        return None
    rows = {Term("column", rows=True, kind=k, of=n): C.Value(F.col(slot(n)), k == "logical", k == "double") for n, k in kinds.items()}
    final: dict[Term, C.Value] = {}
    for t in outer:
        v = column(t.args[0], dict(rows), [], []) if t.args else None
        final[t] = C.aggregate(t.fn, v, bool(t.of), measure=measure)
    v = column(root, final, [], [])
    return C.typed(v.col, root.kind, v.logical)


def _numbered(t: Term) -> bool:
    """Whether a row's number in its iteration enters a term."""
    return t.fn == "seq_along" or any(_numbered(a) for a in t.args)
