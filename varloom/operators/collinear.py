"""Calls from the longest common subsequence of each path with the reference path, without a decomposition."""

from __future__ import annotations

from bisect import bisect_left
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import flip, parse_walk, revcomp
from ..plans.durable import written
from ..session import on_workers
from . import graphs


def chained(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """The longest chain of pairs (i, j) that rises in both. Of several, i goes as far as it can before j moves.

    One pass from the back tells how long a chain each pair can begin. Then each link is a pair beyond the last that
    begins all that is left: that of the very next j and the least i, or else that of the greatest i and the least j.
    """
    order = np.lexsort((i, -j))
    tops: list[int] = []  # at k the greatest i, negated, that begins a chain of k + 1
    reach = np.empty(len(order), "int64")
    for n, x in zip(order.tolist(), (-i[order]).tolist()):
        k = bisect_left(tops, x)
        tops[k : k + 1] = [x]
        reach[n] = k + 1
    order = np.argsort(-reach, kind="stable")
    out: list[tuple[int, int]] = []
    a = b = -1
    for _, same in groupby(zip(reach[order].tolist(), i[order].tolist(), j[order].tolist()), key=itemgetter(0)):
        _, _, _, a, b = min((0, x, 0, x, y) if y == b + 1 else (1, -x, y, x, y) for _, x, y in same if x > a and y > b)
        out.append((a, b))
    return out


def windows(steps: DataFrame, ref_path: int) -> DataFrame:
    """(path_id, ref_start, ref_end, s, e): stretches between consecutive matches of a path with the reference where they differ.

    s and e are the path's first and last step in between. Equal steps meet by a join; a task chains one path's meetings,
    which are pairs of numbers.
    """
    on_workers(steps.sparkSession)
    ref = steps.where(F.col("path_id") == ref_path)
    met = steps.where(F.col("path_id") != ref_path).select("path_id", F.col("step_idx").alias("j"), "seg_id", "strand").join(ref.select(F.col("step_idx").alias("i"), "seg_id", "strand"), ["seg_id", "strand"]).select("path_id", "i", "j")

    def gaps(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(chained(pdf.i.to_numpy(), pdf.j.to_numpy()), "int64").reshape(-1, 2)
        wide = (np.diff(m, axis=0) > 1).any(axis=1)
        return pd.DataFrame({"path_id": pdf.path_id.iloc[0], "ref_start": m[:-1, 0][wide], "ref_end": m[1:, 0][wide], "s": m[:-1, 1][wide] + 1, "e": m[1:, 1][wide] - 1})

    return met.groupBy("path_id").applyInPandas(gaps, "path_id long, ref_start long, ref_end long, s long, e long")


def collinear_sites(steps: DataFrame, ref_path: int) -> DataFrame:
    """(path_id, ref_start, ref_end, ref_walk, alt_walk): windows() that hold no smaller one, and what both walk there.

    ref_start and ref_end are the steps of the reference that match on either side.
    """
    found = written(windows(steps, ref_path), "gaps")
    # a stretch that holds a smaller one is not a site: the least end of those that start later, or as late and end before
    spans = found.select("ref_start", "ref_end").distinct().withColumn("_b", F.floor(F.col("ref_start") / graphs.STEPS))
    least = lambda c, w: F.min(c).over(w.rowsBetween(Window.unboundedPreceding, -1))
    later = spans.groupBy("_b").agg(F.min("ref_end").alias("m")).select("_b", least("m", Window.orderBy(F.desc("_b"))).alias("_later"))  # a row per block
    own = least("ref_end", Window.partitionBy("_b").orderBy(F.desc("ref_start"), "ref_end"))
    leaf = spans.withColumn("_own", own).join(later, "_b").withColumn("_next", F.least("_own", "_later")).where("_next IS NULL OR _next > ref_end").select("ref_start", "ref_end")
    kept = found.join(leaf, ["ref_start", "ref_end"])
    spelled = lambda df: graphs.stretches(df.distinct(), steps, F.struct("step_idx", F.concat("strand", F.col("seg_id").cast("string")).alias("t"))).withColumn("w", F.array_join(F.transform("w", lambda x: x["t"]), ""))
    alt = spelled(kept.select("path_id", "s", "e")).withColumnRenamed("w", "alt_walk")
    own = spelled(leaf.select(F.lit(ref_path).cast("bigint").alias("path_id"), (F.col("ref_start") + 1).alias("s"), (F.col("ref_end") - 1).alias("e")))
    own = own.select((F.col("s") - 1).alias("ref_start"), (F.col("e") + 1).alias("ref_end"), F.col("w").alias("ref_walk"))
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return kept.join(alt, ["path_id", "s", "e"], "left").join(own, ["ref_start", "ref_end"], "left").select("path_id", "ref_start", "ref_end", text("ref_walk"), text("alt_walk"))


def reverse_paths(steps: DataFrame, ref_path: int) -> DataFrame:
    """(path_id) of paths that are the reference path walked backwards: hairpin inversions of the whole."""
    ref, others = steps.where(F.col("path_id") == ref_path), steps.where(F.col("path_id") != ref_path)
    n = ref.count()
    back = ref.select((F.lit(n - 1) - F.col("step_idx")).alias("step_idx"), "seg_id", flip(F.col("strand")).alias("strand"))
    hit = others.join(back, ["step_idx", "seg_id", "strand"]).groupBy("path_id").agg(F.count("*").alias("m")).where(F.col("m") == n)
    return others.groupBy("path_id").agg(F.count("*").alias("m")).where(F.col("m") == n).join(hit, ["path_id", "m"]).select("path_id")


def collinear_calls(steps: DataFrame, segments: DataFrame, paths: DataFrame, ref_path: int) -> DataFrame:
    """(chrom, pos, id, ref_seq, alt, vartype, ac, an): a record per site and type from collinear_sites().

    A haplotype counts as the reference where it walks from the site's start to its end as the reference does; those
    that reach neither are missing. Empty stretches of the reference are insertions, empty ones of the path deletions;
    both are anchored at the last base before.
    """
    sites = written(collinear_sites(steps, ref_path), "sites")
    loci = graphs.with_loci(steps, segments).where(F.col("path_id") == ref_path)
    token = F.concat("strand", F.col("seg_id").cast("string"))
    base = F.when(F.col("strand") == ">", F.col("seq")).otherwise(revcomp(F.col("seq")))
    a = loci.select(F.col("step_idx").alias("ref_start"), token.alias("t0"), F.right(base, F.lit(1)).alias("anchor"), (F.col("locus") + F.length("seq")).alias("next"))
    b = loci.select(F.col("step_idx").alias("ref_end"), token.alias("t1"))
    spot = sites.select("ref_start", "ref_end", "ref_walk").distinct().join(a, "ref_start").join(b, "ref_end")
    # a path walks a site as the reference does where as many steps meet the site's in its order as it has
    walk = spot.select("ref_start", "ref_end", F.explode(F.sequence("ref_start", "ref_end")).alias("step_idx")).join(steps.where(F.col("path_id") == ref_path).drop("path_id"), "step_idx")
    hit = walk.withColumn("k", F.col("step_idx") - F.col("ref_start")).drop("step_idx").join(steps, ["seg_id", "strand"]).groupBy("ref_start", "ref_end", "path_id", F.col("step_idx") - F.col("k")).agg(F.count("*").alias("m"))
    same = hit.where("m = ref_end - ref_start + 1").groupBy("ref_start", "ref_end").agg(F.countDistinct("path_id").alias("n_ref"))
    kind = F.when(F.col("ref_walk") == "", "INS").when(F.col("alt_walk") == "", "DEL").otherwise("SUB")
    seqs = segments.select("seg_id", "seq")

    def spelled(df: DataFrame, walk: str, out: str) -> DataFrame:
        """df with the sequence of a walk; equal walks are spelled once."""
        w = df.select(walk).distinct()
        t = w.select(walk, F.posexplode(parse_walk(F.col(walk))).alias("k", "t")).select(walk, "k", F.col("t.seg_id").alias("seg_id"), F.col("t.orient").alias("strand")).join(seqs, "seg_id")
        g = t.groupBy(walk).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", base.alias("b")))), lambda x: x["b"]), "").alias(out))
        return df.join(g, walk, "left").withColumn(out, F.coalesce(out, F.lit("")))

    alts = sites.withColumn("vartype", kind).groupBy("ref_start", "ref_end", "ref_walk", "alt_walk", "vartype").agg(F.count("*").alias("ac"))
    alts = spelled(spelled(alts, "ref_walk", "rs"), "alt_walk", "as_").join(spot.drop("ref_walk"), ["ref_start", "ref_end"]).join(same, ["ref_start", "ref_end"], "left")
    prefix = F.when(F.col("vartype") == "SUB", "").otherwise(F.col("anchor"))
    rec = alts.groupBy("ref_start", "ref_end", "vartype", "t0", "t1", "next", "n_ref", F.concat(prefix, "rs").alias("ref_seq")).agg(F.sort_array(F.collect_list(F.struct("alt_walk", F.concat(prefix, "as_").alias("dna"), "ac"))).alias("alts"))
    chrom = paths.where(F.col("path_id") == ref_path).select(F.col("name").alias("chrom"))
    return rec.join(chrom).select("chrom", (F.col("next") - F.expr("IF(vartype = 'SUB', 0, 1)")).cast("bigint").alias("pos"), F.concat("t0", "t1").alias("id"), "ref_seq", F.array_join(F.transform("alts", lambda x: x["dna"]), ",").alias("alt"), "vartype", F.array_join(F.transform("alts", lambda x: x["ac"].cast("string")), ",").alias("ac"), (F.coalesce("n_ref", F.lit(0)) + F.aggregate("alts", F.lit(0).cast("bigint"), lambda n, x: n + x["ac"])).alias("an"))
