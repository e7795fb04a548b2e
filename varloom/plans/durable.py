"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where it is unset and Spark runs on one machine one is made and set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="varloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/varloom/{name}-{uuid.uuid4().hex}"


_traces: list[list[tuple[str, int, int]]] = []


@contextmanager
def traced() -> Iterator[list[tuple[str, int, int]]]:
    """Within it every table that written() makes is told as (stage, rows, nanoseconds), in the order of their ends.

    Rows are counted as they are written, so tracing starts no job of its own.
    """
    told: list[tuple[str, int, int]] = []
    _traces.append(told)
    try:
        yield told
    finally:
        _traces.remove(told)


def stage_costs(told: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """(stage, calls, items, elapsed_ns) of a trace, stages in the order of their first ends."""
    out: dict[str, list[int]] = {}
    for stage, rows, ns in told:
        sums = out.setdefault(stage, [0, 0, 0])
        for i, x in enumerate((1, rows, ns)):
            sums[i] += x
    return [(stage, *sums) for stage, sums in out.items()]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: cuts lineage, and outlives any executor."""
    path = new_path(df.sparkSession, name)
    if _traces:
        began = time.perf_counter_ns()
        seen_df, seen = observed(df, name)
        seen_df.write.parquet(path)
        row = (name, seen.get["items"], time.perf_counter_ns() - began)
        for told in _traces:
            told.append(row)
    else:
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._varloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later step reads."""
    for t in tables:
        path = getattr(t, "_varloom_path", None)
        if path:
            p = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with the rank of each row by `order` from 0, without a window over the whole table.

    Rows are range-sorted and written with their place in their range; the ranges' counts before give the rest.
    """
    low = (1 << 33) - 1
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    ranged = written(ranged, "ranged").withColumn("_p", F.shiftright("_m", 33))
    before = ranged.groupBy("_p").count()  # a row per range
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_p", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("_before"))
    return ranged.join(before, "_p").select(*df.columns, (F.col("_before") + F.col("_m").bitwiseAND(F.lit(low))).cast("bigint").alias(name))


def observed(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """df with a count of its rows that the returned observation tells once an action has run: a trace of stages' sizes."""
    seen = Observation(stage)
    return df.observe(seen, F.count(F.lit(1)).alias("items")), seen
