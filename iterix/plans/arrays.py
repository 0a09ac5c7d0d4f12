"""Statistics on whole vectors: one row an iteration, its vectors as sorted arrays.

For what has no row-by-row form: indexing, concatenation, repetition, recycled
constant vectors, loops. Each step of the statistic becomes a column of its own, built
from Spark's array functions; a loop is a fold over an array whose state holds the
names that it assigns. All numbers are doubles here, and truth is 0 or 1.

An iteration's vectors are in one row, so this form is for iterations that fit an
executor's memory; statistics that can be staged aggregates never come here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iterix.functions import columns as C
from iterix.functions.registry import FUNCTIONS, result_kind, widest
from iterix.plans.compile import Bound
from iterix.plans.rows import slot, source_columns
from iterix.plans.tree import Call, Const, Name, Node, StatError, assigned

_EMPTY = "array<double>"


@dataclass(frozen=True)
class Vec:
    """A double, or an array of them. length: 1, or what tells arrays of equal length, or None."""

    col: Column
    array: bool
    kind: str = "double"
    length: object = None


@dataclass(frozen=True)
class Unequal:
    """What a name stands for after branches that give it different lengths; using it is an error."""


def empty() -> Column:
    return F.array().cast(_EMPTY)


def scalar(col: Column, kind: str = "double") -> Vec:
    return Vec(col, False, kind, 1)


def as_array(v: Vec) -> Column:
    return v.col if v.array else F.array(v.col)


def size(v: Vec) -> Column:
    return F.size(v.col) if v.array else F.lit(1)


def upto(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def _number(v: C.Value) -> Column:
    return v.col.cast("double")


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def _fail(message: str, kind: str = "double") -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


class Arrays:
    """Builds the columns of one statistic."""

    def __init__(self, df: DataFrame, bound: Bound, vectors: dict[str, Vec]):
        self.df, self.inside, self.steps = df, 0, 0
        self.names: dict[str, Vec | Unequal] = dict(vectors)
        for name, v in bound.constants.items():
            if all(isinstance(x, (bool, int, float)) or x is None for x in v):
                self.names[name] = self.constant(tuple(v))

    def keep(self, v: Vec) -> Vec:
        """v as a column of its own, but for what is inside a loop."""
        if self.inside:
            return v
        self.steps += 1
        name = f"_s{self.steps}"
        self.df = self.df.withColumn(name, v.col)
        return Vec(F.col(name), v.array, v.kind, v.length)

    @staticmethod
    def constant(values: tuple) -> Vec:
        kinds = ["logical" if isinstance(x, bool) or x is None else "integer" if isinstance(x, int) else "double" for x in values]
        cells = [F.lit(None if x is None else float(x)).cast("double") for x in values]
        if len(values) == 1:
            return scalar(cells[0], kinds[0])
        return Vec(F.array(*cells).cast(_EMPTY), True, widest(kinds), len(values))

    def build(self, node: Node) -> Vec | Unequal:
        if isinstance(node, Const):
            return self.constant(node.value if isinstance(node.value, tuple) else (node.value,))
        if isinstance(node, Name):
            found = self.names.get(node.id)
            if found is None:
                raise StatError(f"`{node.id}` is not found")
            if isinstance(found, Unequal):
                raise StatError(f"`{node.id}` has different lengths in different branches")
            return found
        if node.fn == "{":
            out: Vec | Unequal = Vec(empty(), True, "double", 0)
            for a in node.args:
                out = self.build(a)
            return out
        if node.fn == "<-":
            value = self.keep(self.value(node.args[1]))
            self.names[node.args[0].id] = value
            return value
        if node.fn == "if":
            return self.branch(node)
        if node.fn == "for":
            return self.loop(node)
        f = FUNCTIONS[node.fn]
        constants = {n: a.value for n, a in zip(node.names, node.args) if n in f.constant}
        args = [self.value(a) for n, a in zip(node.names, node.args) if n not in f.constant]
        if node.fn not in ("c", "length", "sum", "all", "any"):
            args = [a if isinstance(n, (Name, Const)) else self.keep(a) for a, n in zip(args, [x for k, x in zip(node.names, node.args) if k not in f.constant])]
        kinds = dict(zip([p for p in f.params if p not in f.constant], [a.kind for a in args]))
        col, array, length = self.call(node.fn, args, constants)
        return Vec(col, array, result_kind(f, kinds, [a.kind for a in args]), length)

    def value(self, node: Node) -> Vec:
        out = self.build(node)
        if isinstance(out, Unequal):
            raise StatError("the branches of a condition have different lengths")
        return out

    # calls

    def elementwise(self, f, a: Vec, b: Vec) -> tuple[Column, bool, object]:
        if not a.array and not b.array:
            return f(a.col, b.col), False, 1
        if not b.array:
            return F.transform(a.col, lambda x: f(x, b.col)), True, a.length
        if not a.array:
            return F.transform(b.col, lambda y: f(a.col, y)), True, b.length
        if a.length is not None and a.length == b.length:
            return F.zip_with(a.col, b.col, f), True, a.length
        m, n = F.size(a.col), F.size(b.col)
        longest = F.when((m == 0) | (n == 0), 0).otherwise(F.greatest(m, n))
        return F.transform(upto(longest), lambda k: f(F.get(a.col, k % F.size(a.col)), F.get(b.col, k % F.size(b.col)))), True, None

    def call(self, fn: str, args: list[Vec], constants: dict) -> tuple[Column, bool, object]:
        value = lambda v, k: C.Value(v, False, k != "logical")
        if fn in ("&&", "||"):
            x, y = (self.single(a, fn) for a in args)
            return _number(C.binary(fn, C.Value(x), C.Value(y))), False, 1
        if FUNCTIONS[fn].size == "recycled":
            a, b = args
            return self.elementwise(lambda x, y: _number(C.binary(fn, value(x, a.kind), value(y, b.kind))), a, b)
        if fn in ("uplus", "uminus", "!", "square"):
            f = lambda x: _number(C.unary(fn, value(x, args[0].kind)))
            return (F.transform(args[0].col, f), True, args[0].length) if args[0].array else (f(args[0].col), False, 1)
        if FUNCTIONS[fn].aggregate:
            return self.aggregate(fn, args, bool(constants.get("na.rm", False))), False, 1
        return getattr(self, {"[": "subset"}.get(fn, fn))(*args, **{k.replace(".", "_"): v for k, v in constants.items()})

    def single(self, v: Vec, fn: str) -> Column:
        if not v.array:
            return v.col
        return F.when(F.size(v.col) > 1, _fail(f"`{fn}` takes single values")).otherwise(F.get(v.col, F.lit(0)))

    def aggregate(self, fn: str, args: list[Vec], na_rm: bool) -> Column:
        if fn == "length":
            return size(args[0]).cast("double")
        if fn in ("all", "any"):
            parts = [F.transform(as_array(a), lambda x: C.truth(C.Value(x))) for a in args]
            v = F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.array().cast("array<boolean>")
            if na_rm:
                v = F.filter(v, lambda x: x.isNotNull())
            return (F.exists(v, lambda x: x) if fn == "any" else F.forall(v, lambda x: x)).cast("double")

        def total(a: Column, scale: float = 1.0) -> Column:
            return F.aggregate(a, F.lit(0.0), lambda s, x: s + x / scale)

        parts = []
        for a in args:
            v = as_array(a)
            if na_rm:
                v = self.keep(Vec(F.filter(v, lambda x: ~_missing(x)), True)).col
            if fn == "sum":
                parts.append(total(v))
                continue
            n, s = F.size(v), total(v)
            out = s / n
            if fn == "mean":
                out = F.when(F.abs(s) == float("inf"), total(v, C._SCALE) / n * C._SCALE).otherwise(out)
            return F.when(n == 0, F.lit(C.NAN)).otherwise(out)
        out = parts[0] if parts else F.lit(0.0)
        for p in parts[1:]:
            out = out + p
        return out

    def ifelse(self, test: Vec, yes: Vec, no: Vec) -> tuple[Column, bool, object]:
        def pick(v: Vec, k: Column) -> Column:
            return F.when(F.size(v.col) > 0, F.get(v.col, k % F.size(v.col))) if v.array else v.col

        def one(t: Column, k: Column) -> Column:
            return F.when(_missing(t), F.lit(None).cast("double")).when(t != 0, pick(yes, k)).otherwise(pick(no, k))

        if not test.array:
            return one(test.col, F.lit(0)), False, 1
        return F.transform(test.col, one), True, test.length

    def seq_along(self, v: Vec) -> tuple[Column, bool, object]:
        return (F.transform(v.col, lambda x, k: (k + 1).cast("double")), True, v.length) if v.array else (F.lit(1.0), False, 1)

    def numeric_along(self, v: Vec) -> tuple[Column, bool, object]:
        return F.transform(as_array(v), lambda x: F.lit(0.0)), True, v.length

    def numeric_alongn(self, *vs: Vec) -> tuple[Column, bool, object]:
        n = F.lit(1)
        for v in vs:
            n = n * size(v)
        return F.array_repeat(F.lit(0.0), n), True, None

    def numeric(self, length: object) -> tuple[Column, bool, object]:
        from iterix.plans.local import whole

        n = whole(length, "length")
        return (F.array_repeat(F.lit(0.0), n), True, n) if n else (empty(), True, 0)

    def c(self, *vs: Vec) -> tuple[Column, bool, object]:
        return (F.concat(*[as_array(v) for v in vs]), True, None) if vs else (empty(), True, 0)

    def rep(self, x: Vec, times: object, length_out: object, each: object) -> tuple[Column, bool, object]:
        from iterix.plans.local import missing, whole

        first = lambda v: v[0] if isinstance(v, tuple) else v
        v, n_each = as_array(x), 1 if missing(first(each)) else whole(first(each), "each")
        if n_each != 1:
            v = F.flatten(F.transform(v, lambda e: F.array_repeat(e, n_each)))
        v = self.keep(Vec(v, True)).col
        if not missing(first(length_out)):
            n = whole(first(length_out), "length.out")
            return F.transform(upto(F.lit(n)), lambda k: F.when(F.size(v) > 0, F.get(v, k % F.size(v)))), True, n
        if isinstance(times, tuple):
            counts = F.array(*[F.lit(whole(t, "times")) for t in times])
            made = F.flatten(F.zip_with(v, counts, lambda e, t: F.array_repeat(e, t)))
            return F.when(F.size(v) == len(times), made).otherwise(_fail("`times` must have one element, or one for each element of `x`", _EMPTY)), True, None
        return F.flatten(F.array_repeat(v, whole(times, "times"))), True, None

    def subset(self, x: Vec, i: Vec) -> tuple[Column, bool, object]:
        v = as_array(x)

        def at(k: Column) -> Column:
            bad = _fail("only strictly positive indices are supported")
            return F.when(_missing(k) | (k >= F.size(v) + 1), F.lit(None).cast("double")).when(k < 1, bad).otherwise(F.get(v, F.floor(k).cast("int") - 1))

        return (F.transform(i.col, at), True, i.length) if i.array else (at(i.col), False, 1)

    def subassign(self, x: Vec, s: Vec, y: Vec) -> tuple[Column, bool, object]:
        v = as_array(x)
        n = F.size(v)

        def checked(k: Column) -> Column:
            return F.when(_missing(k) | (k >= n + 1) | (k < 1), _fail("an index to assign to is missing, not positive or beyond the end")).otherwise(F.floor(k) - 1)

        if not s.array and not y.array:
            k = F.floor(s.col).cast("int")
            bad = _missing(s.col) | (s.col >= n + 1) | (s.col < 1)
            new = F.concat(F.slice(v, F.lit(1), k - 1), F.array(y.col), F.slice(v, k + 1, n)).cast(_EMPTY)
            return F.when(bad, _fail("an index to assign to is missing, not positive or beyond the end", _EMPTY)).otherwise(new), True, x.length
        at, new = F.transform(as_array(s), checked), as_array(y)

        def step(state: Column, k: Column) -> Column:
            value = F.when(F.size(new) > 0, F.get(new, k % F.size(new))).otherwise(_fail("nothing to assign"))
            return F.transform(state, lambda e, j: F.when(j == F.get(at, k), value).otherwise(e))

        return F.aggregate(upto(F.size(at)), v.cast(_EMPTY), step), True, x.length

    # control flow

    def condition(self, node: Node) -> Column:
        v = self.value(node)
        col = F.when(F.size(v.col) == 1, F.get(v.col, F.lit(0))).otherwise(_fail("a condition must have one element")) if v.array else v.col
        return self.keep(scalar(F.when(_missing(col), _fail("a condition must not be missing")).otherwise(col))).col != 0

    def branch(self, node: Call) -> Vec | Unequal:
        test = self.condition(node.args[0])
        before = dict(self.names)
        self.inside += 1  # a branch that isn't taken must not be computed on its own
        yes = self.build(node.args[1])
        after_yes, self.names = self.names, dict(before)
        no = self.build(node.args[2]) if len(node.args) > 2 else Vec(empty(), True, "double", 0)
        after_no = self.names
        self.inside -= 1
        self.names = dict(before)
        for name in dict.fromkeys([n for a in node.args[1:] for n in assigned(a)]):
            a, b = after_yes.get(name), after_no.get(name)
            merged = self.either(test, a, b) if a is not None and b is not None else Unequal()
            self.names[name] = self.keep(merged) if isinstance(merged, Vec) else merged
        return self.either(test, yes, no)

    def either(self, test: Column, a: Vec | Unequal, b: Vec | Unequal) -> Vec | Unequal:
        if isinstance(a, Unequal) or isinstance(b, Unequal):
            return Unequal()
        if a.length is not None and b.length is not None and a.length != b.length:
            return Unequal()
        kind, array = widest([a.kind, b.kind]), a.array or b.array
        x, y = (as_array(v).cast(_EMPTY) if array else v.col for v in (a, b))
        return Vec(F.when(test, x).otherwise(y), array, kind, a.length if a.length == b.length else None)

    def loop(self, node: Call) -> Vec:
        var, body = node.args[0].id, node.args[2]
        over = self.keep(self.value(node.args[1]))
        names = list(dict.fromkeys([var, *assigned(body)]))
        outside = dict(self.names)

        def start(name: str) -> Vec:
            v = outside.get(name)
            return v if isinstance(v, Vec) and name != var else Vec(F.lit(None).cast("double"), False, over.kind if name == var else "logical", 1)

        arrays = {n: start(n).array for n in names}
        kinds = {n: start(n).kind for n in names}
        lengths = {n: start(n).length if arrays[n] else 1 for n in names}

        def fold() -> tuple[Column, dict[str, Vec]]:
            after: dict[str, Vec] = {}

            def cell(v: Vec, n: str) -> Column:
                return (as_array(v).cast(_EMPTY) if arrays[n] else v.col.cast("double")).alias(f"v{names.index(n)}")

            def step(state: Column, element: Column) -> Column:
                self.names = dict(outside)
                for n in names:
                    self.names[n] = Vec(state[f"v{names.index(n)}"], arrays[n], kinds[n], lengths[n])
                self.names[var] = scalar(element, over.kind)
                self.inside += 1
                self.build(body)
                self.inside -= 1
                for n in names:
                    v = self.names[n]
                    if isinstance(v, Unequal):
                        raise StatError(f"`{n}` has different lengths in different branches")
                    after[n] = v
                return F.struct(*[cell(after[n], n) for n in names])

            init = F.struct(*[cell(start(n), n) for n in names])
            return F.aggregate(as_array(over), init, step), after

        while True:  # until what the names hold after the body is what they hold before it
            whole, after = fold()
            now = ({n: arrays[n] or v.array for n, v in after.items()}, {n: widest([kinds[n], v.kind]) for n, v in after.items()}, {n: v.length if v.length == lengths[n] else None for n, v in after.items()})
            if now == (arrays, kinds, lengths):
                break
            arrays, kinds, lengths = now
        state = self.keep(Vec(whole, False)).col
        self.names = dict(outside)
        for n in names:
            self.names[n] = Vec(state[f"v{names.index(n)}"], arrays[n], kinds[n], lengths[n])
        return Vec(empty(), True, "double", 0)


def lower(bound: Bound, df: DataFrame, keys: list[str], order: list[str], present: str | None, name: str) -> DataFrame:
    """keys and the statistic, for each value of the keys: one row if it is single, else a row for each element, with its place idx."""
    df, kinds = source_columns(df, bound)
    vectors: dict[str, Vec] = {}
    if kinds:
        if not order:
            raise StatError("this statistic depends on the order of its elements; name the order's columns")
        cells = F.struct(*[F.col(o).alias(f"o{k}") for k, o in enumerate(order)], *[F.col(slot(n)).cast("double").alias(f"v{k}") for k, n in enumerate(kinds)])
        listed = F.array_sort(F.collect_list(F.when(F.col(present), cells) if present else cells))
        df = df.groupBy(*keys).agg(listed.alias("_rows"))
        for k, (n, kind) in enumerate(kinds.items()):
            df = df.withColumn(f"_v_{n}", F.col("_rows")[f"v{k}"])  # the field of every row
            vectors[n] = Vec(F.col(f"`_v_{n}`"), True, kind, "rows")
    else:
        df = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    a = Arrays(df, bound, vectors)
    root = a.keep(a.value(bound.tree))
    if not root.array:
        return a.df.select(*keys, C.typed(root.col, root.kind, False).alias(name))
    out = a.df.select(*keys, F.posexplode(root.col).alias("idx", "_e"))
    return out.select(*keys, (F.col("idx") + 1).alias("idx"), C.typed(F.col("_e"), root.kind, False).alias(name))


def is_single(bound: Bound, df: DataFrame) -> bool:
    """Whether the statistic is one value by construction."""
    _, kinds = source_columns(df, bound)
    a = Arrays(df, bound, {n: Vec(F.col("x"), True, k, "rows") for n, k in kinds.items()})
    a.inside = 1
    return not a.value(bound.tree).array
