"""The choice between staged aggregates and arrays."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iterix.plans import arrays, rows
from iterix.plans.compile import Bound, Stat, bind
from iterix.plans.tree import StatError

Data = Mapping[str, str | Column] | Sequence[str | Column] | str


def bound(stat: Stat, data: Data, more: Mapping | Sequence | None) -> Bound:
    return bind(stat, [data] if isinstance(data, str) else data, more or {})


def lower(b: Bound, df: DataFrame, keys: list[str], order: list[str], present: str | None, name: str, lowering: str = "auto") -> DataFrame:
    """lowering: 'rows', 'arrays', or 'auto', which takes rows where it can."""
    if lowering not in ("auto", "rows", "arrays"):
        raise StatError("lowering must be 'auto', 'rows' or 'arrays'")
    can = rows.is_rowwise(b) and bool(b.data) and (bool(order) or not rows.uses_order(b))
    if lowering == "rows" and not can:
        raise StatError("the statistic can't be computed without its vectors, or needs an order")
    if lowering != "arrays" and can:
        try:
            return rows.lower(b, df, keys, order, present, name)
        except rows.NeedsVectors:
            if lowering == "rows":
                raise
    return arrays.lower(b, df, keys, order, present, name)


def is_single(b: Bound, df: DataFrame) -> bool:
    """Whether the statistic is one value whatever the data."""
    if rows.is_rowwise(b) and b.data:
        try:
            return not rows.Terms(b, rows.source_columns(df, b)[1]).value(b.tree).rows
        except rows.NeedsVectors:
            pass
    return arrays.is_single(b, df)


def settled(b: Bound, df: DataFrame, names: Sequence[str], *more: Column) -> tuple[Bound, DataFrame, dict[str, str]]:
    """df reduced to the statistic's columns, those of names and more, under names that clash with nothing; and the new names of names."""
    columns = {f"_x{k}": (F.col(f"`{c}`") if isinstance(c, str) else c) for k, c in enumerate(b.data.values())}
    new = {n: f"_c{k}" for k, n in enumerate(dict.fromkeys(names))}
    out = df.select(*[c.alias(n) for n, c in columns.items()], *[F.col(f"`{n}`").alias(c) for n, c in new.items()], *more, F.lit(True).alias("_row"))
    return Bound(b.tree, dict(zip(b.data, columns)), b.constants, b.env), out, new


def named(result: DataFrame, new: Mapping[str, str], name: str) -> DataFrame:
    """The result under the names that its user knows."""
    back = {c: n for n, c in new.items()} | {"_value": name}
    names = [back.get(c, c) for c in result.columns]
    twice = [n for n in names if sum(n.lower() == m.lower() for m in names) > 1]
    if twice:
        raise StatError(f"the result would have two columns `{twice[0]}`; rename the column, or name the value otherwise")
    return result.toDF(*names)


def plan(stat: Stat, df: DataFrame, data: Data, by: str | Sequence[str] = (), more: Mapping | Sequence | None = None) -> str:
    """How a statistic of groups runs: its code, then the aggregates of each level, or that its vectors are held in arrays."""
    b = bound(stat, data, more)
    lines = [stat.code()]
    if not (rows.is_rowwise(b) and b.data):
        return "\n".join([*lines, "arrays: one row holds the vectors of an iteration"])
    try:
        root = rows.Terms(b, rows.source_columns(df, b)[1]).value(b.tree)
    except rows.NeedsVectors:
        return "\n".join([*lines, "arrays: one row holds the vectors of an iteration"])
    inner: dict = {}
    outer: dict = {}
    rows._aggregates(root, root.rows, inner, outer)
    keys = ", ".join([by] if isinstance(by, str) else by) or "all rows"
    for level in sorted({t.level for t in inner}):
        lines.append(f"level {level}: " + ", ".join(rows.shown(t) for t in inner if t.level == level) + f"; by {keys}, joined back to the rows")
    if root.rows:
        return "\n".join([*lines, f"each row: {rows.shown(root)}"])
    return "\n".join([*lines, "last: " + ", ".join(rows.shown(t) for t in outer) + f"; by {keys}", f"value: {rows.shown(root)}"])
