"""Calls for GFA files as they arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.graph_api import Graph


def call_stream(spark: SparkSession, folder: str, refs: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Every file of the folder becomes a graph of its own, and its calls a Parquet folder per batch and file below out.

    A batch that is run again after a failure overwrites what it had written, so calls appear once. Invalid files raise.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", 8).text(folder).select(F.col("_metadata.file_path").alias("file"), "value")

    def run(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for k, (name,) in enumerate(kept.select("file").distinct().orderBy("file").collect()):  # at most 8
            own = kept.where(F.col("file") == name).select(F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value")).where("value <> ''")
            Graph.from_lines(own).gfa2vcf(refs).withColumn("file", F.lit(name)).write.mode("overwrite").parquet(f"{out}/batch={number}/part={k}")
        kept.unpersist()

    return lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

