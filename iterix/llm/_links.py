"""Shared storage, row filters and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from iterix.llm import _bpe


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of its own only where the session names none and runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = f"file://{tempfile.mkdtemp(prefix='iterix-')}"
        spark.sparkContext.setCheckpointDir(own)
    return own


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/iterix-{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, nor one that starts with it."""
    while any(c.lower().startswith(name) for c in df.columns):
        name = "_" + name
    return name


def stored(df: DataFrame) -> DataFrame:
    """df, computed once into the shared folder; later reads do not depend on the executors that made it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept_rows(df: DataFrame, keep: Callable[[list], Iterable[bool]]) -> DataFrame:
    """The rows of df, all columns as they are, for which keep(texts) says so.

    Texts go to the workers once, within their rows, and are judged in runs of about 1 MB,
    so besides the batch that Spark sends a worker holds one run's objects and result."""
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    at = df.columns.index("text") if "text" in df.columns else None
    if at is None or not isinstance(df.schema[at].dataType, T.StringType):
        at, whole = None, df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col("text").cast("string").alias("text"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _bpe.release()
        for batch in batches:
            rows = batch.column(0)
            texts = batch.column(1) if at is None else rows.field(at)
            for first, run in _bpe.runs(texts):
                yield pa.RecordBatch.from_arrays([rows.slice(first, len(run)).filter(pa.array(list(keep(run)), pa.bool_()))], ["row"])

    return whole.mapInArrow(choose, T.StructType([whole.schema["row"]])).select("row.*")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the
    edge set is a forest of stars. All state stays in distributed tables, cut by
    a checkpoint each round; only two sums come to the driver.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v")))).otherwise(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = stored(small)
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
