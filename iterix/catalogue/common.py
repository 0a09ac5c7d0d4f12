"""What the catalogue's queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
Entry = tuple[Query, str]

#: Sums of doubles depend on their order in the last places; results are compared to so many digits.
DIGITS = 4
#: Means of decimal numbers can end in a 5 just there; times this, they don't.
UNTIED = 0.7310585786


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """df with its column value rounded, if it is a double."""
    if df.schema["value"].dataType.simpleString() != "double":
        return df
    # as SQL engines do it, on the number times a power of 10, not on its decimal digits
    scaled = F.col("value") * F.lit(10.0**digits)
    whole = F.when(F.abs(scaled) < 2.0**52, F.round(scaled)).otherwise(scaled)
    return df.withColumn("value", F.when(F.abs(scaled) < float("inf"), whole / F.lit(10.0**digits)).otherwise(F.col("value")))


def columns(data: dict) -> dict:
    """data with its functions replaced by the columns they make; columns need a running session."""
    return {k: v() if callable(v) else v for k, v in data.items()}


def holes(name: str, above: float) -> Column:
    """A column with NULL for the values above a limit."""
    return F.when(F.col(name) <= above, F.col(name))
