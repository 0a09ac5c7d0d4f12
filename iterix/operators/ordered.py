"""A table's rows in one order, without bringing them to one task.

The first order column is cut into ranges at approximate quantiles, each range is
sorted by itself, and counts of the ranges, one number each, give every range its base.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from iterix.plans.tree import StatError


def position(df: DataFrame, name: str) -> Column:
    """A column as a number that orders rows: times as microseconds."""
    kind = df.schema[name].dataType.simpleString()
    c = F.col(name)
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return c.cast("double")
    raise StatError(f"`{name}` must be a number, a date or a time to order by, not {kind}")


def ranges(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def quantiles(df: DataFrame, column: str, n: int) -> list[float]:
    """Up to n - 1 places that cut a column's numbers into about equal shares."""
    cuts = sorted(set(df.approxQuantile(column, [k / n for k in range(1, n)], 1 / (20 * n)))) if n > 1 else []
    return [c for c in cuts if c == c]


def between_cuts(df: DataFrame, column: str, cuts: list[float], name: str) -> DataFrame:
    """df with a column name: between which of the cuts a number is, from 0; NaN comes after all, and NULL with it."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    split = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol=column, outputCol=name, handleInvalid="keep")
    return split.transform(df).withColumn(name, F.coalesce(F.col(name), F.lit(len(cuts) + 1.0)).cast("int"))


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df with a column _range: rows of a lower range come before those of a higher one. Ties share a range."""
    df = df.withColumn("_at", position(df, order[0]))
    return between_cuts(df, "_at", quantiles(df, "_at", ranges(df)), "_range")


def _sorted(df: DataFrame, order: list[str]) -> Window:
    # all columns break ties, so that each run gives the rows the same places
    rest = [c for c in df.columns if c not in (*order, "_range") and "map<" not in df.schema[c].dataType.simpleString()]
    return Window.partitionBy("_range").orderBy(*[F.col(o).asc_nulls_last() for o in order], *[F.col(f"`{c}`") for c in rest])


def _base(by_range: dict[int, int]) -> Column:
    """A column with the value of each row's range."""
    return F.get(F.array(*[F.lit(by_range.get(k, 0)).cast("bigint") for k in range(max(by_range, default=0) + 1)]), F.col("_range"))


def indexed(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """(df with a column _idx, from 1, in the order; the number of rows)."""
    columns = df.columns
    df = ranged(df, order)
    counts = {r["_range"]: r["n"] for r in df.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # one row a range
    bases, total = {}, 0
    for k in sorted(counts):
        bases[k], total = total, total + counts[k]
    numbered = df.withColumn("_idx", (F.row_number().over(_sorted(df, order)) + _base(bases)).cast("bigint"))
    return numbered.select(*[F.col(f"`{c}`") for c in columns], "_idx"), total


def run_ids(df: DataFrame, key: str, order: list[str], peers: bool = False) -> DataFrame:
    """df with a column run, from 1: equal neighbours in the order share it. peers: rows that the order leaves tied share the last one's."""
    columns = df.columns
    df = ranged(df, order)
    w = _sorted(df, order)
    changed = F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise((~F.col(key).eqNullSafe(F.lag(key).over(w))).cast("int"))
    df = df.withColumn("_first", F.row_number().over(w) == 1).withColumn("_last", F.row_number().over(w) == F.count("*").over(Window.partitionBy("_range")))
    upto = Window.partitionBy("_range").orderBy(*[F.col(o).asc_nulls_last() for o in order]).rangeBetween(Window.unboundedPreceding, 0) if peers else w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_changed", changed).withColumn("_steps", F.sum("_changed").over(upto))
    ends = df.where("_first or _last").groupBy("_range").agg(F.max(F.when(F.col("_first"), F.struct(F.col(key).alias("k")))).alias("first"), F.max(F.when(F.col("_last"), F.struct(F.col(key).alias("k")))).alias("last"), F.max("_steps").alias("steps"))
    bases, run, last = {}, 0, None
    for r in sorted(ends.collect(), key=lambda r: r["_range"]):  # one row a range
        if last is None or r["first"]["k"] != last:
            run += 1
        bases[r["_range"]], last = run, r["last"]["k"]
        run += r["steps"]
    return df.withColumn("run", (F.col("_steps") + _base(bases)).cast("bigint")).select(*[F.col(f"`{c}`") for c in columns], "run")
