"""Views of paths and calls: contexts around steps, windows, genotype tables, repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def step_context(steps: DataFrame, seg_id: int, around: int = 10) -> DataFrame:
    """(path_id, step_idx, context): the walk of up to `around` steps on either side of every step on a segment.

    Only the steps around those on the segment are read: a range of each is met by the steps' numbers.
    """
    at = steps.where(F.col("seg_id") == seg_id).select("path_id", F.col("step_idx").alias("at"))
    near = at.withColumn("step_idx", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - around), F.col("at") + around))).join(steps, ["path_id", "step_idx"])
    walk = F.sort_array(F.collect_list(F.struct("step_idx", F.concat("strand", F.col("seg_id").cast("string")).alias("t"))))
    return near.groupBy("path_id", F.col("at").alias("step_idx")).agg(F.array_join(F.transform(walk, lambda x: x["t"]), "").alias("context"))


def path_window(steps: DataFrame, path_id: int, mid: int, each_side: int = 250) -> DataFrame:
    """The steps of a path around one place."""
    return steps.where((F.col("path_id") == path_id) & F.col("step_idx").between(mid - each_side, mid + each_side))


def passes(steps: DataFrame, seg_id: int) -> DataFrame:
    """(path_id, step_idx, strand, nth): every place where a path passes the segment of a number, counted along the path."""
    nth = F.row_number().over(Window.partitionBy("path_id").orderBy("step_idx"))
    return steps.where(F.col("seg_id") == seg_id).select("path_id", "step_idx", "strand", nth.alias("nth"))


def genotype_table(genotypes: DataFrame, samples: list[str]) -> DataFrame:
    """genotypes(id, vartype, hap_col, allele) with a column per sample."""
    names = F.create_map(*[x for i, s in enumerate(samples) for x in (F.lit(i), F.lit(s))])
    return genotypes.withColumn("_s", F.element_at(names, F.col("hap_col").cast("int"))).groupBy("id", "vartype").pivot("_s", samples).agg(F.min("allele"))


def longest_loop(steps: DataFrame) -> DataFrame:
    """(path_id, seg_id, times): the segment that each path passes most often, the smaller one on ties."""
    n = steps.groupBy("path_id", "seg_id").agg(F.count("*").alias("times"))
    best = n.groupBy("path_id").agg(F.max(F.struct("times", (-F.col("seg_id")).alias("s"))).alias("m"))
    return best.select("path_id", (-F.col("m.s")).alias("seg_id"), F.col("m.times").alias("times"))


def repeats(steps: DataFrame, min_times: int = 2) -> DataFrame:
    """(path_id, seg_id, times, first_step, last_step) of segments that a path passes min_times or more."""
    n = steps.groupBy("path_id", "seg_id").agg(F.count("*").alias("times"), F.min("step_idx").alias("first_step"), F.max("step_idx").alias("last_step"))
    return n.where(F.col("times") >= min_times)
