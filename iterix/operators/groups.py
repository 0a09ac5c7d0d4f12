"""Statistics of a whole DataFrame, of its groups, and of runs of equal keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from iterix.operators.lowering import Data, bound, lower, named, settled
from iterix.operators.ordered import run_ids
from iterix.plans.compile import Stat
from iterix.plans.tree import StatError

_WHOLE = ("tinyint", "smallint", "int", "bigint", "string", "boolean", "date")


def _list(x: str | Sequence[str] | None) -> list[str]:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def run(stat: Stat, df: DataFrame, data: Data, more: Mapping | Sequence | None = None, *, order: str | Sequence[str] | None = None, name: str = "value", lowering: str = "auto") -> DataFrame:
    """The statistic of all rows: one row if it is a single value, else one for each element."""
    b, df, new = settled(bound(stat, data, more), df, _list(order))
    return named(lower(b, df, [], [new[o] for o in _list(order)], None, "_value", lowering), new, name)


def process_groups(df: DataFrame, by: str, *, strict: bool = True) -> DataFrame:
    """df with its group key as groups compare it: with strict, fractional keys are cut to whole numbers, and NaN is NA."""
    kind = df.schema[by].dataType.simpleString()
    if kind in ("float", "double") or kind.startswith("decimal"):
        if strict:
            c = F.col(by).cast("double")
            return df.withColumn(by, F.when(~F.isnan(c), c).cast("bigint"))
    elif kind not in _WHOLE:
        raise StatError(f"can't group by `{by}`, a column of {kind}")
    return df


def group_exec(
    stat: Stat, df: DataFrame, data: Data, by: str | Sequence[str], more: Mapping | Sequence | None = None, *, order: str | Sequence[str] | None = None, strict: bool = True, name: str = "value", lowering: str = "auto"
) -> DataFrame:
    """The statistic of each group of rows with equal keys; NULL is a key.

    Returns the keys and the value. A statistic that isn't a single value gives a row for
    each element: with its place idx, or, where elements belong to rows, with the order's
    columns. Rows come in no order. order: what puts a group's elements in order, for
    statistics that depend on it.
    """
    keys = _list(by)
    if not keys:
        raise StatError("name the groups' columns")
    for k in keys:
        df = process_groups(df, k, strict=strict)
    b, df, new = settled(bound(stat, data, more), df, [*keys, *_list(order)])
    return named(lower(b, df, [new[k] for k in keys], [new[o] for o in _list(order)], None, "_value", lowering), new, name)


def run_exec(
    stat: Stat, df: DataFrame, data: Data, by: str, more: Mapping | Sequence | None = None, *, order: str | Sequence[str], peers: bool = False, name: str = "value", lowering: str = "auto"
) -> DataFrame:
    """As group_exec, for rows taken as sorted: neighbours in the order with equal keys are a group. Returns run (from 1), the key and the value.

    peers: rows that the order leaves tied share one number, that of the last of them.
    """
    b, df, new = settled(bound(stat, data, more), process_groups(df, by), [by, *_list(order)])
    order = [new[o] for o in _list(order)]
    df = run_ids(df, new[by], order, peers)
    return named(lower(b, df, ["run", new[by]], order, None, "_value", lowering), new, name)
