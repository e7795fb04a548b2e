"""Regions that haplotypes pass more than once: laps, their alignment, and calls lap by lap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import on_workers
from .align import align


def region_laps(cols: DataFrame, loci: DataFrame) -> DataFrame:
    """(rov_id, path_id, lap_no, first_step, last_step, lap): maximal runs of consecutive steps inside each region.

    lap holds the steps in order (step_idx, orient, seg_id, locus, seq).
    """
    s = loci.join(cols.select("rov_id", "seg_id"), "seg_id")
    w = Window.partitionBy("rov_id", "path_id").orderBy("step_idx")
    s = s.withColumn("island", F.col("step_idx") - F.row_number().over(w))
    g = s.groupBy("rov_id", "path_id", "island").agg(F.sort_array(F.collect_list(F.struct("step_idx", F.col("strand").alias("orient"), "seg_id", "locus", "seq"))).alias("lap"))
    g = g.withColumn("first_step", F.get("lap", F.lit(0))["step_idx"]).withColumn("last_step", F.element_at("lap", -1)["step_idx"])
    return g.withColumn("lap_no", (F.row_number().over(Window.partitionBy("rov_id", "path_id").orderBy("first_step")) - 1).cast("bigint")).drop("island")


def transcripts(laps: DataFrame, refs: DataFrame) -> DataFrame:
    """(rov_id, ref, hap, transcript): each haplotype's laps aligned to each called reference's, a lap as one letter."""
    on_workers(laps.sparkSession)
    token = F.array_join(F.transform("lap", lambda x: F.concat(x["orient"], x["seg_id"].cast("string"))), "")
    whole = laps.select("rov_id", "path_id", "lap_no", token.alias("t")).groupBy("rov_id", "path_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("lap_no", "t"))), lambda x: x["t"]).alias("laps"))
    r = whole.join(refs.select("path_id").distinct(), "path_id").select("rov_id", F.col("path_id").alias("ref"), F.col("laps").alias("a"))
    both = r.join(whole.select("rov_id", F.col("path_id").alias("hap"), F.col("laps").alias("b")), "rov_id")

    def run(it):
        for pdf in it:
            yield pdf[["rov_id", "ref", "hap"]].assign(transcript=[align(list(a), list(b)) for a, b in zip(pdf.a, pdf.b)])

    return both.mapInPandas(run, "rov_id string, ref long, hap long, transcript string")


def lap_pairs(trans: DataFrame) -> DataFrame:
    """(rov_id, ref, hap, ref_lap, hap_lap, op) of the aligned laps; each side's laps are counted by themselves."""

    def run(it):
        for pdf in it:
            out = []
            for rov, ref, hap, t in pdf[["rov_id", "ref", "hap", "transcript"]].itertuples(index=False):
                i = j = 0
                for op in t:
                    if op in "MX":
                        out.append((rov, ref, hap, i, j, op))
                    i += op != "I"
                    j += op != "D"
            yield pd.DataFrame(out, columns=["rov_id", "ref", "hap", "ref_lap", "hap_lap", "op"])

    return trans.mapInPandas(run, "rov_id string, ref long, hap long, ref_lap long, hap_lap long, op string")


def unrolled(cols: DataFrame, laps: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions of one reference lap each, for laps that some haplotype's differ from: (columns, laps by rov_id and path_id).

    Their rov_id tells region, reference and lap, so that what calls plain regions calls these.
    """
    new_id = F.concat_ws("#", "rov_id", F.col("ref").cast("string"), F.col("ref_lap").cast("string"))
    differ = pairs.where("op = 'X'").select("rov_id", "ref", "ref_lap").distinct()
    own = pairs.join(differ, ["rov_id", "ref", "ref_lap"]).select("rov_id", "ref", "ref_lap", new_id.alias("new_id"), F.col("hap").alias("path_id"), F.col("hap_lap").alias("lap_no"))
    new_laps = own.join(laps, ["rov_id", "path_id", "lap_no"]).select(F.col("new_id").alias("rov_id"), "path_id", "ref", "lap")
    new_cols = differ.withColumn("new_id", new_id).select("rov_id", "new_id").join(cols, "rov_id").drop("rov_id").withColumnRenamed("new_id", "rov_id")
    return new_cols, new_laps


def lap_visits(cols: DataFrame, laps: DataFrame) -> DataFrame:
    """calling.visits() of laps(rov_id, path_id, lap)."""
    from .calling import visited

    steps = laps.select("rov_id", "path_id", F.explode("lap").alias("x")).select("rov_id", "path_id", F.col("x.step_idx").alias("step_idx"), F.col("x.seg_id").alias("seg_id"), F.col("x.orient").alias("strand"))
    return visited(steps.join(cols.select("rov_id", "col", "seg_id"), ["rov_id", "seg_id"]))
