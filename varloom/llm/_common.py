"""Shared plumbing of the training-data operators: table access, tasks on Arrow batches, components."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import star_edges
from ..plans.durable import discard, new_path, written  # noqa: F401
from ..session import on_workers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return on_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Give memory that this process has freed back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), with this package importable where it runs."""
    on_workers(df.sparkSession)

    def task(batches):
        for out in run(batches):
            yield out
            release()

    return df.mapInArrow(task, schema)


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of edges(a, b): one row (id, root) per id in an edge, root the smallest id reachable.

    Alternating large-star and small-star steps: each is one shuffle that keeps at most one row per edge, so a hub
    costs its degree once and the number of rounds grows with the logarithm of the diameter. Every round is written to
    the shared folder, and the loop ends when a round leaves the edges as they were. Null ends and self-links are
    ignored. Raises if max_rounds do not suffice.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    e = star_edges(e, max_rounds)
    roots = e.select(F.col("v").alias("id")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots.select("id", F.col("id").alias("root")))
