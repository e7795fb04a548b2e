"""Inversions: pins where a haplotype reads the reference backwards, grown to whole stretches, as SUBR records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import flip, half_gap, revcomp
from . import graphs


def whole_pins(seen: DataFrame, anch: DataFrame) -> DataFrame:
    """(ref, alt, i, j): regions of more than one column that a haplotype visits wholly inverted, by the reference's first step there and the haplotype's last."""
    n = seen.groupBy("rov_id", "path_id").agg(F.count("*").alias("n"))
    inv = anch.where("ref <> hap").groupBy("rov_id", "ref", "hap").agg(F.sum(F.expr("CAST(eq = 0 AS BIGINT)")).alias("inv"), F.min("rf").alias("i"), F.max("hl").alias("j"))
    r, h = n.select("rov_id", F.col("path_id").alias("ref"), F.col("n").alias("rn")), n.select("rov_id", F.col("path_id").alias("hap"), F.col("n").alias("hn"))
    return inv.join(r, ["rov_id", "ref"]).join(h, ["rov_id", "hap"]).where("inv > 1 AND inv = rn AND inv = hn").select("ref", F.col("hap").alias("alt"), "i", "j")


def local_pins(seen: DataFrame, anch: DataFrame) -> DataFrame:
    """(ref, alt, i, j): pieces of two columns or more that a haplotype reads backwards, within regions that it does not invert whole.

    A piece is a run of shared columns of which none is read alike; its pin is the reference's first step there and the
    haplotype's last. Columns that only one of the two visits don't end a piece, as growing the pin compares all steps.
    """
    whole = whole_pins(seen, anch)
    runs = anch.where("ref <> hap AND eq = 0").groupBy("rov_id", "ref", "hap", "ce").agg(F.count("*").alias("n"), F.min("rf").alias("i"), F.max("hl").alias("j"))
    pins = runs.where("n > 1").select("ref", F.col("hap").alias("alt"), "i", "j").distinct()
    return pins.join(whole, ["ref", "alt", "i", "j"], "left_anti")


def paired(pins: DataFrame, refs: DataFrame) -> DataFrame:
    """pins, and those between two of refs(path_id) again from the other's side: a chain takes the pins of an unordered pair."""
    back = pins.join(refs.select(F.col("path_id").alias("alt")).distinct(), "alt", "left_semi").select(F.col("alt").alias("ref"), F.col("ref").alias("alt"), F.col("j").alias("i"), F.col("i").alias("j"))
    return pins.select("ref", "alt", "i", "j").unionByName(back).distinct()


def limits(pins: DataFrame) -> DataFrame:
    """pins with how far each may grow: half the gap to the pins before and after on the reference; no limit at the ends."""
    w = Window.partitionBy("ref", "alt").orderBy("i", "j")
    p = pins.distinct()
    return p.withColumn("down", half_gap(F.col("i"), F.lag("i").over(w))).withColumn("up", half_gap(F.col("i"), F.lead("i").over(w)))


def merged(spans: DataFrame) -> DataFrame:
    """spans(ref, alt, ref_start, alt_start, len) without repeats and parts: what no order of adding them one by one changes.

    A span reads ref from ref_start on forwards and alt from alt_start + len - 1 on backwards; the sum of both is its
    turning point. Of two spans of one pair
      equal ones are one;
      with one turning point, that touch or overlap, the one is extended by the other on the left or right, or held by it
      or put in its place where it is longer: they are one span;
      with different turning points, one whose place on alt lies within the longer other's goes, and of those with the
      same place on alt the first on ref stays;
      all others stay: other haplotypes at the same start, other places of one haplotype at the same start (inverted
      repeats), and places apart.
    """
    at = ("ref", "alt", "turn")
    s = spans.select("ref", "alt", "ref_start", "alt_start", "len").distinct().withColumn("turn", F.col("ref_start") + F.col("alt_start") + F.col("len")).withColumn("end", F.col("alt_start") + F.col("len"))
    by = Window.partitionBy(*at).orderBy("alt_start", "end")
    s = s.withColumn("new", F.coalesce(F.col("alt_start") > F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    s = s.withColumn("group", F.sum(F.col("new").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    one = s.groupBy(*at, "group").agg(F.min("alt_start").alias("alt_start"), F.max("end").alias("end"))
    one = one.select("ref", "alt", (F.col("turn") - F.col("end")).alias("ref_start"), "alt_start", "end")
    over = Window.partitionBy("ref", "alt").orderBy("alt_start", F.desc("end"), "ref_start").rowsBetween(Window.unboundedPreceding, -1)
    return one.withColumn("held", F.max("end").over(over)).where("held IS NULL OR held < end").select("ref", "alt", "ref_start", "alt_start", (F.col("end") - F.col("alt_start")).alias("len"))


def stretches(pins: DataFrame, steps: DataFrame) -> DataFrame:
    """(ref, alt, ref_start, alt_start, len): merged inverted stretches of two steps or more.

    What alt reads backwards of ref meets by segment and opposite strand; meetings around one turning point (the sum of
    both places) in a row are a stretch. It is cut to the limits of the pin within it; merged() joins them.
    """
    p = limits(pins).withColumn("turn", F.col("i") + F.col("j"))
    r = steps.select(F.col("path_id").alias("ref"), F.col("step_idx").alias("a"), "seg_id", "strand").join(p.select("ref", "alt").distinct(), "ref")
    h = steps.select(F.col("path_id").alias("alt"), F.col("step_idx").alias("b"), "seg_id", flip(F.col("strand")).alias("strand"))
    met = r.join(h, ["alt", "seg_id", "strand"]).select("ref", "alt", "a", (F.col("a") + F.col("b")).alias("turn")).join(p.select("ref", "alt", "turn").distinct(), ["ref", "alt", "turn"], "left_semi")
    island = F.col("a") - F.row_number().over(Window.partitionBy("ref", "alt", "turn").orderBy("a"))
    runs = met.withColumn("island", island).groupBy("ref", "alt", "turn", "island").agg(F.min("a").alias("lo"), F.max("a").alias("hi"))
    grown = p.join(runs, ["ref", "alt", "turn"]).where("i BETWEEN lo AND hi").withColumn("c", F.greatest("lo", F.col("i") - F.col("down"))).withColumn("d", F.least("hi", F.col("i") + F.col("up")))
    grown = grown.where("d > c").select("ref", "alt", F.col("c").alias("ref_start"), (F.col("turn") - F.col("d")).alias("alt_start"), (F.col("d") - F.col("c") + 1).alias("len"))
    return merged(grown)


def subr_records(found: DataFrame, loci: DataFrame, paths: DataFrame) -> DataFrame:
    """(chrom, pos, id, ref_seq, alt, ac, an, ns, at, hap_cols): one record per reference start and length.

    The position is that of the second step, as for substitutions; REF and ALT are the whole stretches.
    """
    base = F.when(F.col("strand") == ">", F.col("seq")).otherwise(revcomp(F.col("seq")))
    step = loci.select("path_id", "step_idx", "locus", F.concat("strand", F.col("seg_id").cast("string")).alias("t"), base.alias("b"))

    def told(side: str, start: str, prefix: str) -> DataFrame:
        x = found.select("ref", "alt", "ref_start", "alt_start", "len", F.col(side).alias("path_id"), F.explode(F.sequence(F.col(start), F.col(start) + F.col("len") - 1)).alias("step_idx")).join(step, ["path_id", "step_idx"])
        g = x.groupBy("ref", "alt", "ref_start", "alt_start", "len").agg(F.sort_array(F.collect_list(F.struct("step_idx", "t", "b", "locus"))).alias("w"))
        return g.select("ref", "alt", "ref_start", "alt_start", "len", F.array_join(F.transform("w", lambda y: y["t"]), "").alias(prefix + "walk"), F.array_join(F.transform("w", lambda y: y["b"]), "").alias(prefix + "seq"), F.get("w", F.lit(1))["locus"].alias(prefix + "pos"), F.get("w", F.lit(0))["t"].alias(prefix + "first"), F.element_at("w", -1)["t"].alias(prefix + "last"))

    both = told("ref", "ref_start", "r").join(told("alt", "alt_start", "a"), ["ref", "alt", "ref_start", "alt_start", "len"])
    gt = graphs.genotype_columns(paths).select(F.col("path_id").alias("alt"), "hap_col")
    g = both.join(gt, "alt").groupBy("ref", "ref_start", "len", "rwalk", "rseq", "rpos", "rfirst", "rlast", "awalk", "aseq").agg(F.sort_array(F.collect_list("hap_col")).alias("haps"))
    g = g.groupBy("ref", "ref_start", "len", "rwalk", "rseq", "rpos", "rfirst", "rlast").agg(F.sort_array(F.collect_list(F.struct("awalk", "aseq", "haps"))).alias("alts"))
    n = F.aggregate("alts", F.lit(0).cast("bigint"), lambda acc, x: acc + F.size(x["haps"]))
    text = lambda f: F.array_join(F.transform("alts", f), ",")
    return g.join(paths.select(F.col("path_id").alias("ref"), F.col("name").alias("chrom")), "ref").select("chrom", F.col("rpos").alias("pos"), F.concat("rfirst", "rlast").alias("id"), F.col("rseq").alias("ref_seq"), text(lambda x: x["aseq"]).alias("alt"), text(lambda x: F.size(x["haps"]).cast("string")).alias("ac"), (n + 1).alias("an"), (n + 1).alias("ns"), F.concat_ws(",", "rwalk", text(lambda x: x["awalk"])).alias("at"), F.array_join(F.flatten(F.transform("alts", lambda x: x["haps"])).cast("array<string>"), ",").alias("hap_cols"))
