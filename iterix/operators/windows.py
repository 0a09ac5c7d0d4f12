"""Statistics of rolling windows.

All runners reduce to one relation: which rows are in which window. Windows of a
fixed number of rows whose statistic has plain aggregates run on Spark's window
frames, over ranges of rows that each carry a margin from their neighbours, so that no
task holds all rows. All others are a range join: positions are cut into cells of
about a window's width, a window meets the cells that it reaches, and the cell is the
join's key; the statistic is then a grouping by window, with partial sums before the
exchange. Windows of one width whose statistic has plain aggregates need no join: running
aggregates over pieces of positions, read at the windows' ends, make them up. Nor do those at
regular steps whose width is a multiple of the step: rows are summed up by step once, and
windows add up steps. Empty windows stay: the function runs on vectors of no elements.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iterix.functions import columns as C
from iterix.operators.groups import _list
from iterix.operators.lowering import Data, bound, is_single, lower, named, settled
from iterix.operators.ordered import between_cuts, indexed, position, quantiles, ranges
from iterix.plans import rows
from iterix.plans.compile import Bound, Stat
from iterix.plans.tree import StatError

BOUNDS = ("()", "[)", "(]", "[]")


def _checked(b: Bound, df: DataFrame) -> Bound:
    if not b.data:
        raise StatError("a window runner needs data")
    if not is_single(b, df):
        raise StatError("a statistic of windows must be a single value")
    return b


def _with_data(b: Bound, df: DataFrame, more: list[Column]) -> tuple[Bound, DataFrame]:
    """df reduced to the statistic's columns, under names that clash with nothing, and more."""
    columns = {f"_x{k}": (F.col(f"`{c}`") if isinstance(c, str) else c) for k, c in enumerate(b.data.values())}
    out = df.select(*[c.alias(n) for n, c in columns.items()], *more)
    return Bound(b.tree, dict(zip(b.data, columns)), b.constants, b.env), out


def _inside(pos: Column, left: Column, right: Column, bounds: str) -> Column:
    if bounds not in BOUNDS:
        raise StatError(f"bounds must be one of {', '.join(BOUNDS)}")
    after = pos >= left if bounds[0] == "[" else pos > left
    before = pos <= right if bounds[1] == "]" else pos < right
    return after & before


def window_values(b: Bound, data: DataFrame, windows: DataFrame, keys: list[str], bounds: str, name: str, order: list[str], lowering: str) -> DataFrame:
    """The statistic of data (_pos, ...) in each of windows (keys, _left, _right)."""
    span = data.agg(F.min("_pos").alias("lo"), F.max("_pos").alias("hi")).first()
    lo, hi = (span["lo"], span["hi"]) if span["lo"] is not None else (0.0, 0.0)
    inner = windows.select(*keys, F.greatest("_left", F.lit(lo)).alias("_from"), F.least("_right", F.lit(hi)).alias("_to"), "_left", "_right")
    width = inner.where("_to >= _from").agg(F.avg(F.col("_to") - F.col("_from")).alias("w")).first()["w"] or 0.0
    # cells of about a window's width, but no more cells than keep a range of rows together
    cell = max(width, (hi - lo) / (1 << 24), math.ulp(max(abs(lo), abs(hi), 1.0)) * 4)
    number = lambda c: F.floor((c - F.lit(lo)) / F.lit(cell)).cast("bigint")
    # windows that meet no position keep to themselves, each in a cell without rows
    nowhere = -1 - F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    cells = F.when(F.col("_to") >= F.col("_from"), F.sequence(number(F.col("_from")), number(F.col("_to")))).otherwise(F.array(nowhere))
    met = inner.select(*keys, "_left", "_right", F.explode(cells).alias("_cell"))
    right = data.withColumn("_at_cell", number(F.col("_pos"))).withColumn("_present", F.lit(True))
    on = (F.col("_cell") == F.col("_at_cell")) & _inside(F.col("_pos"), F.col("_left"), F.col("_right"), bounds)
    member = met.join(right, on, "left").withColumn("_present", F.coalesce("_present", F.lit(False)))
    return lower(b, member, keys, order, "_present", name, lowering)


def _offset(align: str | int, n: int) -> int:
    """From a window's anchor to its first row."""
    if isinstance(align, int):
        return align
    if align not in ("left", "center", "right"):
        raise StatError("align must be left, center, right or a whole number")
    return {"left": 0, "center": int((1 - n) / 2), "right": 1 - n}[align]


def rolli_exec(
    stat: Stat, df: DataFrame, data: Data, n: int | str, by: int = 1, align: str | int = "center", partial: bool = False, more: Mapping | Sequence | None = None, *, order: str | Sequence[str], name: str = "value", lowering: str = "auto"
) -> DataFrame:
    """Windows of n rows in the order, around each by-th row; n may be a column with a width for each row.

    align: where a window's anchor stands in it, or the offset of its first row.
    partial: whether windows that reach beyond the ends are computed on what is there, or are NULL.
    Returns iter, the place of the anchor among the windows, from 1; the order's columns of the anchor; the value.
    """
    order = _list(order)
    if by < 1:
        raise StatError("by must be 1 or more")
    b = _checked(bound(stat, data, more), df)
    fixed = isinstance(n, int)
    if fixed and n < 0:
        raise StatError("n must be 0 or more")
    b, df, new = settled(b, df, order, *([] if fixed else [F.col(f"`{n}`").cast("bigint").alias("_n")]))
    order = list(new.values())
    df, total = indexed(df.drop("_row"), order)
    size = F.lit(n).cast("bigint") if fixed else F.when(F.col("_n") >= 0, F.col("_n")).otherwise(F.raise_error(F.lit("n must be 0 or more")).cast("bigint"))
    first: Column
    if isinstance(align, int):
        first = F.lit(align).cast("bigint")
    elif fixed:
        first = F.lit(_offset(align, n)).cast("bigint")
    else:
        _offset(align, 1)
        first = {"left": F.lit(0).cast("bigint"), "center": -F.floor((size - 1) / 2), "right": 1 - size}[align]
        first = F.when(size == 0, F.lit(0)).otherwise(first).cast("bigint") if align == "center" else first
    anchor = (F.col("_idx") - 1) % by == 0
    iteration = (F.floor((F.col("_idx") - 1) / by) + 1).cast("bigint").alias("iter")
    start, end = F.col("_idx") + first, F.col("_idx") + first + size - 1
    clipped = (start < 1) | (end > total)
    lo = _offset(align, n) if fixed else 0
    if fixed and lowering != "arrays" and rows.is_rowwise(b) and 0 < n:
        _, kinds = rows.source_columns(df, b)
        # beyond the ends there is nothing, so wider frames need not be asked for
        low, high = max(lo, -total), min(lo + n - 1, total)
        if low <= high and rows.measured_by(b, kinds, C.measured) is not None:
            runner = _running if n >= _WIDE and low == lo and high == lo + n - 1 else _framed
            return named(runner(b, df, low, high, total, order, anchor, iteration, None if partial else clipped, "_value"), new, name)
    keyed = df.where(anchor).select(iteration, *order, (start.cast("double")).alias("_left"), (end.cast("double")).alias("_right"), clipped.alias("_clipped"))
    points = df.withColumn("_pos", F.col("_idx").cast("double")).drop(*order, "_n")
    found = window_values(b, points, keyed, ["iter", *order, "_clipped"], "[]", "_value", ["_pos"], lowering)
    return named(found.select("iter", *order, (F.col("_value") if partial else F.when(~F.col("_clipped"), F.col("_value"))).alias("_value")), new, name)


#: From so many rows on, a window is put together from running sums rather than gone through.
_WIDE = 64


def _running(b: Bound, df: DataFrame, low: int, high: int, total: int, order: list[str], anchor: Column, iteration: Column, clipped: Column | None, name: str) -> DataFrame:
    """Wide frames in a number of steps that does not depend on their width.

    Rows are cut into pieces as long as a window. A window is then the end of one piece
    and the start of the next: running aggregates from both ends of each piece hold
    them, and nothing is ever subtracted.
    """
    df, kinds = rows.source_columns(df, b)
    n = high - low + 1
    df = df.select("_idx", *order, *[rows.slot(p) for p in kinds]).withColumn("_piece", F.floor((F.col("_idx") - 1) / n))
    up = Window.partitionBy("_piece").orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_piece").orderBy(F.col("_idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    parts: list[tuple[str, Column]] = []

    def place(kind: str, c: Column) -> str:
        k = next((k for k, (of, d) in enumerate(parts) if of == kind and str(d) == str(c)), len(parts))
        if k == len(parts):
            parts.append((kind, c))
        return str(k)

    first, last = F.greatest(F.col("_idx") + low, F.lit(1)), F.least(F.col("_idx") + high, F.lit(total))
    piece = lambda c: F.floor((c - 1) / n)
    none = first > last
    ends = ~none & (F.col("_idx") + low >= 1)  # from its first row to its piece's end
    starts = ~none & ((F.col("_idx") + low < 1) | (piece(last) > piece(first)))  # from its last piece's start to its last row

    def measure(kind: str, c: Column) -> Column:
        k = place(kind, c)
        a, z = F.when(ends, F.col(f"_z{k}")), F.when(starts, F.col(f"_a{k}"))
        if kind == "max":
            return F.greatest(a, z)
        both = F.coalesce(a, F.lit(0)) + F.coalesce(z, F.lit(0))
        return both if kind == "count" else F.when(a.isNotNull() | z.isNotNull(), both)

    value = rows.measured_by(b, kinds, measure)
    made = {f"_u{k}": C.measured(kind, c).over(up) for k, (kind, c) in enumerate(parts)} | {f"_d{k}": C.measured(kind, c).over(down) for k, (kind, c) in enumerate(parts)}
    df = df.withColumns(made)
    # running values from the window's first and last rows: they are at fixed distances, in blocks with margins
    spread, of = _blocks(df, low, high, total, [*order, *made])
    w = Window.partitionBy("_block").orderBy("_idx")
    at_first, at_last = {}, {}
    for k in range(len(parts)):
        # where the window is cut off, its first row is row 1, which no running value is needed of, or its last is the last row
        at_first[f"_z{k}"] = _at(F.col(f"_d{k}"), low, w)
        at_last[f"_a{k}"] = F.coalesce(_at(F.struct(F.col(f"_u{k}").alias("v")), high, w), F.last(F.struct(F.col(f"_u{k}").alias("v"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))["v"]
    out = spread.withColumns(at_first | at_last).withColumn(name, value).where(F.col("_own") == F.col("_block")).where(anchor)
    result = F.col(name) if clipped is None else F.when(~clipped, F.col(name))
    return out.select(iteration, *order, result.alias(name))


def _at(c: Column, distance: int, w: Window) -> Column:
    return F.lead(c, distance).over(w) if distance >= 0 else F.lag(c, -distance).over(w)


def _blocks(df: DataFrame, low: int, high: int, total: int, kept: list[str]) -> tuple[DataFrame, object]:
    """Rows in blocks, each with the rows that its windows reach; _own is a row's own block."""
    low, high = min(low, 0), max(high, 0)  # with all rows between, as distances are counted in rows
    block = max(high - low + 1, -(-max(total, 1) // ranges(df)), 1024)
    of = lambda c: F.floor((F.least(F.greatest(c, F.lit(1)), F.lit(max(total, 1))) - 1) / block).cast("bigint")
    reaches = F.sequence(of(F.col("_idx") - high), of(F.col("_idx") - low))
    return df.select("_idx", *kept, of(F.col("_idx")).alias("_own"), F.explode(reaches).alias("_block")), of


def _framed(b: Bound, df: DataFrame, low: int, high: int, total: int, order: list[str], anchor: Column, iteration: Column, clipped: Column | None, name: str) -> DataFrame:
    """Frames over blocks of rows; a row goes to its own block and to those whose windows reach it."""
    df, kinds = rows.source_columns(df, b)
    spread, _ = _blocks(df, low, high, total, [*order, *[rows.slot(p) for p in kinds]])
    frame = Window.partitionBy("_block").orderBy("_idx").rowsBetween(low, high)
    value = rows.measured_by(b, kinds, C.over(frame))
    out = spread.withColumn(name, value).where(F.col("_own") == F.col("_block")).where(anchor)
    result = F.col(name) if clipped is None else F.when(~clipped, F.col(name))
    return out.select(iteration, *order, result.alias(name))


def _positioned(b: Bound, df: DataFrame, place: str | None, order: str | Sequence[str] | None) -> tuple[Bound, DataFrame]:
    """df reduced to the statistic's columns and _pos: the column place, or each row's number in the order."""
    if place is not None:
        return _with_data(b, df, [position(df, place).alias("_pos")])
    if order is None:
        raise StatError("name the column of positions, or the order's")
    b, df, new = settled(b, df, _list(order))
    df, _ = indexed(df.drop("_row"), list(new.values()))
    return b, df.withColumn("_pos", F.col("_idx").cast("double")).drop(*new.values(), "_idx")


def rollby_exec(
    stat: Stat, df: DataFrame, data: Data, width: float, by: float, offset: float = 0.0, position: str | None = None, start: float | None = None, end: float | None = None, bounds: str = "[)", more: Mapping | Sequence | None = None, *, order: str | Sequence[str] | None = None, name: str = "value", lowering: str = "auto"
) -> DataFrame:
    """Windows at each multiple of by from start to end: from start + offset + by * k, width wide.

    Positions are numbers; times count in microseconds, dates in days. start and end
    default to the first and the last position. Returns iter (from 1), left, right, value.
    """
    if by <= 0 or width < 0:
        raise StatError("by must be more than 0, and width 0 or more")
    b, df = _positioned(_checked(bound(stat, data, more), df), df, position, order)
    if start is None or end is None:
        span = df.agg(F.min("_pos").alias("lo"), F.max("_pos").alias("hi")).first()
        start = span["lo"] if start is None else start
        end = span["hi"] if end is None else end
    spark = df.sparkSession
    if start is None or end is None:
        count, start = 0, 0.0
    else:
        if end < start:
            raise StatError("end must not be before start")
        count = math.floor((end - start) / by) + 1
    k = F.col("id").cast("double")
    left = F.lit(float(start) + float(offset)) + F.lit(float(by)) * k
    windows = spark.range(count).select((F.col("id") + 1).alias("iter"), left.alias("left"), (left + F.lit(float(width))).alias("right"))
    base = float(start) + float(offset)
    panes = _panes(base, float(by), float(width), bounds, count)
    if panes and lowering != "arrays" and rows.is_rowwise(b):
        slots, kinds = rows.source_columns(df, b)
        if rows.measured_by(b, kinds, C.measured) is not None:
            return _paned(b, slots, kinds, base, float(by), panes, count, windows, name)
    return _valued(b, df, windows, float(width), bounds, name, lowering)


def _panes(base: float, by: float, width: float, bounds: str, count: int) -> int:
    """How many panes, each as wide as the step, make up a window; 0 if edges would not fall on panes' edges exactly."""
    whole = all(x == math.floor(x) for x in (base, by, width)) and max(abs(base), abs(base + by * count) + width) < 2**53
    return int(width // by) if whole and bounds == "[)" and width % by == 0 else 0


def _paned(b: Bound, df: DataFrame, kinds: dict[str, str], base: float, by: float, panes: int, count: int, windows: DataFrame, name: str) -> DataFrame:
    """Each row goes into one pane; panes are measured once, and windows put their panes together."""
    pane = F.floor((F.col("_pos") - F.lit(base)) / F.lit(by))
    low = F.lit(base) + F.lit(by) * pane  # rounding may put a row next to its pane
    pane = F.when(F.col("_pos") < low, pane - 1).when(F.col("_pos") >= low + F.lit(by), pane + 1).otherwise(pane).cast("bigint")
    block = max(panes, -(-max(count, 1) // ranges(df)), 1024)
    frame = Window.partitionBy("_block").orderBy("_pane").rangeBetween(0, panes - 1)
    parts: dict[str, tuple[str, Column]] = {}

    def measure(kind: str, c: Column) -> Column:
        part = next((k for k, (of, d) in parts.items() if of == kind and str(d) == str(c)), f"_m{len(parts)}")
        parts[part] = (kind, c)
        if kind == "max":
            return F.max(part).over(frame)
        total = F.sum(part).over(frame)
        return F.coalesce(total, F.lit(0)) if kind == "count" else total

    value = rows.measured_by(b, kinds, measure)
    measures = [C.measured(kind, c).alias(k) for k, (kind, c) in parts.items()]
    found = df.withColumn("_pane", pane).where((F.col("_pane") >= 0) & (F.col("_pane") < count + panes)).groupBy("_pane").agg(*measures)
    of = lambda c: F.floor(c / block).cast("bigint")
    reached = F.sequence(of(F.greatest(F.col("_pane") - (panes - 1), F.lit(0))), of(F.col("_pane")))
    spread = found.withColumn("_block", F.explode(reached))
    anchors = windows.withColumn("_pane", F.col("iter") - 1).withColumn("_block", of(F.col("iter") - 1))
    both = anchors.unionByName(spread, allowMissingColumns=True)
    return both.withColumn(name, value).where(F.col("iter").isNotNull()).select("iter", "left", "right", name)


def _valued(b: Bound, df: DataFrame, windows: DataFrame, width: float | None, bounds: str, name: str, lowering: str) -> DataFrame:
    """The statistic in windows (iter, left, right), all of them width wide if that is given."""
    if bounds not in BOUNDS:
        raise StatError(f"bounds must be one of {', '.join(BOUNDS)}")
    found = _swept(b, df, windows, width, bounds, name) if width is not None and lowering != "arrays" else None
    if found is not None:
        return found
    windows = windows.select("iter", "left", "right", F.col("left").alias("_left"), F.col("right").alias("_right"))
    return window_values(b, df, windows, ["iter", "left", "right"], bounds, name, ["_pos"], lowering)


def _swept(b: Bound, df: DataFrame, windows: DataFrame, width: float, bounds: str, name: str) -> DataFrame | None:
    """Windows of one width in a number of steps that does not depend on the rows in them, or None if the aggregates aren't plain.

    Positions are cut into pieces narrower than a window, so that a window's ends are in different pieces, and at quantiles,
    so that no piece has more than its share. A window is the end of its first piece, whole pieces, and the start of its last;
    running aggregates of a piece from both sides are read at marks that windows put there. Nothing is ever subtracted.
    """
    if not rows.is_rowwise(b):
        return None
    slots, kinds = rows.source_columns(df, b)
    if rows.measured_by(b, kinds, C.measured) is None:
        return None
    span = df.agg(F.min("_pos").alias("lo"), F.max("_pos").alias("hi")).first()
    lo, hi = span["lo"], span["hi"]
    # a window must be much wider than the distance of neighbouring doubles, or its ends may share a piece
    if lo is None or not all(map(math.isfinite, (lo, hi, width))) or 0 < width < 64 * math.ulp(max(abs(lo), abs(hi)) + width):
        return None
    met = windows.where((F.col("left") <= hi) & (F.col("right") >= lo)).select(F.col("left").alias("_key"), F.col("right").alias("_end")).distinct()
    cuts = quantiles(df.select("_pos").union(met.select("_key")), "_pos", 2 * ranges(df))

    def piece(df: DataFrame, column: str, name: str) -> DataFrame:
        grid = F.floor((F.col(column) - F.lit(lo)) / F.lit(width * 0.875 or 1.0))
        return between_cuts(df, column, cuts, "_cut").withColumn(name, (grid + F.col("_cut")).cast("bigint")).drop("_cut")

    parts: list[tuple[str, Column]] = []

    def measure(kind: str, c: Column) -> Column:
        k = next((k for k, (of, d) in enumerate(parts) if of == kind and str(d) == str(c)), len(parts))
        if k == len(parts):
            parts.append((kind, c))
        three = [F.col(f"_{side}{k}") for side in ("z", "w", "a")]
        if kind == "max":
            return F.greatest(*three)
        total = sum((F.coalesce(c, F.lit(0)) for c in three[1:]), F.coalesce(three[0], F.lit(0)))
        return total if kind == "count" else F.when(F.coalesce(*three).isNotNull(), total)

    value = rows.measured_by(b, kinds, measure)
    merged = lambda k, of="_m": (F.max if parts[k][0] == "max" else F.sum)(f"{of}{k}")
    each = range(len(parts))
    points = slots.where("_pos is not null").groupBy("_pos").agg(*[C.measured(kind, c).alias(f"_m{k}") for k, (kind, c) in enumerate(parts)])
    if width == 0:  # only the rows at one position, or none
        none = [F.lit(None).alias(f"_{side}{k}") for k in each for side in ("z", "a")]
        read = points.where(F.lit(bounds == "[]")).select(F.col("_pos").alias("_at"), *[F.col(f"_m{k}").alias(f"_w{k}") for k in each], *none)
        return windows.join(read, F.col("left") == F.col("_at"), "left").select("iter", "left", "right", value.alias(name))
    points, met = piece(points, "_pos", "_piece"), piece(piece(met, "_key", "_first"), "_end", "_last")
    totals = points.groupBy("_piece").agg(*[merged(k).alias(f"_w{k}") for k in each])
    pairs = met.where("_last - _first > 1").select("_first", "_last").distinct()
    between = pairs.withColumn("_piece", F.explode(F.sequence(F.col("_first") + 1, F.col("_last") - 1))).join(totals, "_piece")
    between = between.groupBy("_first", "_last").agg(*[merged(k, "_w").alias(f"_w{k}") for k in each])

    # both directions in one order: backwards, positions are negative; a mark stands after the rows that its window holds
    def sides(sign: int, end: str, at: str, closed: bool) -> DataFrame:
        place = lambda c: F.lit(0.0) + c if sign > 0 else F.lit(0.0) - c
        held = points.select("_piece", F.lit(sign).alias("_sign"), place(F.col("_pos")).alias("_place"), F.lit(1).alias("_rank"), *[f"_m{k}" for k in each])
        marks = met.select(F.col(end).alias("_piece"), F.lit(sign).alias("_sign"), place(F.col(at)).alias("_place"), F.lit(2 if closed else 0).alias("_rank"), "_key", "_end", "_first", "_last")
        return held.unionByName(marks, allowMissingColumns=True)

    both = sides(-1, "_first", "_key", bounds[0] == "[").unionByName(sides(1, "_last", "_end", bounds[1] == "]"))
    up = Window.partitionBy("_piece", "_sign").orderBy("_place", "_rank").rowsBetween(Window.unboundedPreceding, 0)
    read = both.withColumns({f"_r{k}": merged(k).over(up) for k in each}).where("_rank <> 1")
    at_ends = [F.max(F.when(F.col("_sign") == sign, F.col(f"_r{k}"))).alias(f"_{side}{k}") for k in each for side, sign in (("z", -1), ("a", 1))]
    read = read.groupBy("_key", "_end", "_first", "_last").agg(*at_ends).join(between, ["_first", "_last"], "left")
    read = read.select(F.col("_key").alias("left"), F.col("_end").alias("right"), *[f"_{side}{k}" for k in each for side in ("z", "w", "a")])
    return windows.join(read, ["left", "right"], "left").select("iter", "left", "right", value.alias(name))


def _points(df: DataFrame, values: Sequence[float] | DataFrame, name: str) -> DataFrame:
    """(iter, name): a list in its order, or a DataFrame's only column, or its columns iter and name."""
    if isinstance(values, DataFrame):
        if "iter" in values.columns:
            return values.select(F.col("iter").cast("bigint").alias("iter"), position(values, name).alias(name))
        only = values.columns[0]
        renamed = values.select(position(values, only).alias(name))
        return indexed(renamed, [name])[0].select(F.col("_idx").alias("iter"), name)
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in enumerate(values, 1)], f"iter bigint, {name} double")


def rollat_exec(
    stat: Stat, df: DataFrame, data: Data, width: float, at: Sequence[float] | DataFrame | None = None, offset: float = 0.0, position: str | None = None, bounds: str = "[)", more: Mapping | Sequence | None = None, *, order: str | Sequence[str] | None = None, name: str = "value", lowering: str = "auto"
) -> DataFrame:
    """Windows at given places, by default at each row: from at + offset, width wide. Returns iter (from 1), left, right, value."""
    if width < 0:
        raise StatError("width must be 0 or more")
    b, df = _positioned(_checked(bound(stat, data, more), df), df, position, order)
    points = _points(df, df.select("_pos") if at is None else at, "at")
    left = F.col("at") + F.lit(float(offset))
    return _valued(b, df, points.select("iter", left.alias("left"), (left + F.lit(float(width))).alias("right")), float(width), bounds, name, lowering)


def rollbw_exec(
    stat: Stat, df: DataFrame, data: Data, left: Sequence[float] | DataFrame, right: Sequence[float] | None = None, position: str | None = None, bounds: str = "[)", more: Mapping | Sequence | None = None, *, order: str | Sequence[str] | None = None, name: str = "value", lowering: str = "auto"
) -> DataFrame:
    """Windows between given ends: two lists, or a DataFrame (iter, left, right). Returns iter (from 1), left, right, value."""
    b, df = _positioned(_checked(bound(stat, data, more), df), df, position, order)
    if isinstance(left, DataFrame):
        windows = left.select(F.col("iter").cast("bigint").alias("iter"), F.col("left").cast("double").alias("left"), F.col("right").cast("double").alias("right"))
    else:
        if len(left) != len(right or ()):
            raise StatError("left and right must be equally long")
        windows = df.sparkSession.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(zip(left, right), 1)], "iter bigint, left double, right double")
    return _valued(b, df, windows, None, bounds, name, lowering)
