"""Sites of collinear calls as a containment tree, their alleles by sample, and the one record of a reversed path.

A site is a stretch of the reference path between two steps that some path matches while it differs in between. Sites
that hold no smaller one, strictly on both sides, are called; the larger ones tell their level and parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_walk, revcomp, shortest
from ..plans.durable import written
from . import collinear, graphs


class MixedTypes(ValueError):
    """Alleles of different kinds at one site."""


def site_tree(spans: DataFrame) -> DataFrame:
    """spans(ref_start, ref_end) with leaf, level, parent_start and parent_end.

    A span holds another that begins after and ends before it. level counts those that hold it, the parent is the shortest
    of them, of equally short ones the first. Spans are binned by powers of two of their length: those that hold a span
    stand in the bins of its start at their own length, so they meet by equality.
    """
    s = spans.select("ref_start", "ref_end").distinct()
    s = s.withColumn("_k", F.floor(F.log2(F.greatest(F.lit(1), F.col("ref_end") - F.col("ref_start")))).cast("int"))
    at = lambda x, k: F.floor(F.col(x) / F.pow(F.lit(2.0), F.col(k) + 1)).cast("bigint")
    outer = s.select(F.col("ref_start").alias("a"), F.col("ref_end").alias("b"), F.col("_k").alias("k"), F.explode(F.array_distinct(F.array(at("ref_start", "_k"), at("ref_end", "_k")))).alias("bin"))
    lengths = s.agg(F.collect_set("_k").alias("ks"))  # 63 at most
    inner = s.join(F.broadcast(lengths)).select("ref_start", "ref_end", F.explode(F.filter("ks", lambda k: k >= F.col("_k"))).alias("k")).withColumn("bin", at("ref_start", "k"))
    held = written(inner.join(outer, ["k", "bin"]).where("a < ref_start AND ref_end < b").select("ref_start", "ref_end", "a", "b"), "held")
    up = held.groupBy("ref_start", "ref_end").agg(F.count("*").alias("level"), F.min(F.struct((F.col("b") - F.col("a")).alias("n"), "a", "b")).alias("p"))
    holds = held.select(F.col("a").alias("ref_start"), F.col("b").alias("ref_end")).distinct().withColumn("_holds", F.lit(True))
    out = s.join(up, ["ref_start", "ref_end"], "left").join(holds, ["ref_start", "ref_end"], "left")
    return out.select("ref_start", "ref_end", F.col("_holds").isNull().alias("leaf"), F.coalesce("level", F.lit(0)).alias("level"), F.col("p.a").alias("parent_start"), F.col("p.b").alias("parent_end"))


def sample_layout(paths: DataFrame) -> DataFrame:
    """One row: samples (their names in the order of their first paths) and layout (each sample's paths in order)."""
    named = paths.select("path_id", "name", F.split("name", "#")[0].alias("_s")).withColumn("sample", F.when(F.col("_s") == "", F.col("name")).otherwise(F.col("_s")))
    own = named.groupBy("sample").agg(F.min("path_id").alias("first"), F.sort_array(F.collect_list("path_id")).alias("paths"))
    all_ = own.agg(F.sort_array(F.collect_list(F.struct("first", "sample", "paths"))).alias("x"))
    return all_.select(F.col("x.sample").alias("samples"), F.col("x.paths").alias("layout"))


def site_alleles(tree: DataFrame, steps: DataFrame, ref_path: int) -> DataFrame:
    """(ref_start, ref_end, path_id, walk): what each path has between a called site's two steps, `` for nothing.

    A path's stretch runs from its first step equal to the site's start to the next one equal to its end; paths that lack
    either have no row.
    """
    sites = tree.where("leaf").select("ref_start", "ref_end")
    ref = steps.where(F.col("path_id") == ref_path).select("step_idx", "seg_id", "strand")
    end = lambda c: sites.join(ref.withColumnRenamed("step_idx", c), c).join(steps, ["seg_id", "strand"]).select("ref_start", "ref_end", "path_id", "step_idx")
    first = end("ref_start").groupBy("ref_start", "ref_end", "path_id").agg(F.min("step_idx").alias("a"))
    last = end("ref_end").withColumnRenamed("step_idx", "b").join(first, ["ref_start", "ref_end", "path_id"]).where("b > a").groupBy("ref_start", "ref_end", "path_id", "a").agg(F.min("b").alias("b"))
    spans = written(last.select("ref_start", "ref_end", "path_id", (F.col("a") + 1).alias("s"), (F.col("b") - 1).alias("e")), "spans")
    token = F.struct("step_idx", F.concat("strand", F.col("seg_id").cast("string")).alias("t"))
    walk = graphs.stretches(spans.select("path_id", "s", "e").distinct(), steps, token).select("path_id", "s", "e", F.array_join(F.transform("w", lambda x: x["t"]), "").alias("walk"))
    return spans.join(walk, ["path_id", "s", "e"], "left").select("ref_start", "ref_end", "path_id", F.coalesce("walk", F.lit("")).alias("walk"))


def _spelled(walks: DataFrame, segments: DataFrame) -> DataFrame:
    """(walk, dna) of distinct walks."""
    w = walks.distinct()
    t = w.select("walk", F.posexplode(parse_walk(F.col("walk"))).alias("k", "t")).select("walk", "k", F.col("t.seg_id").alias("seg_id"), F.col("t.orient").alias("strand")).join(segments, "seg_id")
    base = F.when(F.col("strand") == ">", F.col("seq")).otherwise(revcomp(F.col("seq")))
    g = t.groupBy("walk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", base.alias("b")))), lambda x: x["b"]), "").alias("dna"))
    return w.join(g, "walk", "left").select("walk", F.coalesce("dna", F.lit("")).alias("dna"))


def _cells(m: Column, layout: Column) -> Column:
    """A genotype per sample: its paths' alleles joined by |, a full stop where all are missing."""
    one = lambda ps: F.transform(ps, lambda p: F.coalesce(F.element_at(m, p), F.lit(".")))
    return F.transform(layout, lambda ps: F.when(F.exists(one(ps), lambda x: x != "."), F.array_join(one(ps), "|")).otherwise("."))


RECORD = ("chrom", "pos", "id", "ref_seq", "alt", "ac", "af", "an", "ns", "at", "vartype", "es", "lv", "parent", "gts", "first", "last")


def site_calls(steps: DataFrame, segments: DataFrame, paths: DataFrame, ref_path: int) -> DataFrame:
    """A record per called site: RECORD's columns. Sites without another allele than the reference's have none.

    Alleles are numbered as they first come by sample and path. Insertions and deletions stand at the start step and carry
    its whole sequence, substitutions stand at the step after it. lv is the site's level, parent the id of the site around it;
    first and last are the segments of its ends, which order records of one place. Raises MixedTypes' message where a
    site's alleles are of different kinds.
    """
    spans = written(collinear.windows(steps, ref_path).select("ref_start", "ref_end"), "windows")
    tree = written(site_tree(spans), "sites")
    al = written(site_alleles(tree, steps, ref_path), "alleles")
    loci = graphs.with_loci(steps, segments).where(F.col("path_id") == ref_path)
    step = loci.select("step_idx", "seg_id", F.concat("strand", F.col("seg_id").cast("string")).alias("t"), F.when(F.col("strand") == ">", F.col("seq")).otherwise(revcomp(F.col("seq"))).alias("dna"), "locus")
    ends = lambda c, p: step.select(F.col("step_idx").alias(c), *[F.col(x).alias(f"{p}_{x}") for x in ("seg_id", "t", "dna", "locus")])
    spot = tree.where("leaf").join(ends("ref_start", "a"), "ref_start").join(ends("ref_end", "b"), "ref_end")
    outer = tree.where("parent_start IS NOT NULL").select("parent_start", "parent_end").distinct().join(ends("parent_start", "pa"), "parent_start").join(ends("parent_end", "pb"), "parent_end")
    spot = spot.join(outer.select("parent_start", "parent_end", F.concat("pa_t", "pb_t").alias("parent")), ["parent_start", "parent_end"], "left")
    own = al.where(F.col("path_id") == ref_path).select("ref_start", "ref_end", F.col("walk").alias("rwalk"))
    dna = written(_spelled(al.select("walk"), segments), "spelled")
    layout = sample_layout(paths)
    place = layout.select(F.posexplode("layout").alias("s", "ps")).select("s", F.posexplode("ps").alias("k", "path_id"))
    x = al.join(own, ["ref_start", "ref_end"]).join(place, "path_id")
    key = ["ref_start", "ref_end", "rwalk"]
    refs = x.where("walk = rwalk").groupBy(*key).agg(F.collect_list("path_id").alias("refs"))
    alts = x.where("walk <> rwalk").groupBy(*key, "walk").agg(F.min(F.struct("s", "k")).alias("first"), F.collect_list("path_id").alias("paths"))
    alts = alts.join(dna, "walk").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("first", "walk", "dna", "paths"))).alias("alts"))
    rec = alts.join(refs, key, "left").join(dna.select(F.col("walk").alias("rwalk"), F.col("dna").alias("rdna")), "rwalk").join(spot, ["ref_start", "ref_end"])
    kind = lambda w: F.when(F.col("rwalk") == "", "INS").when(w == "", "DEL").otherwise("SUB")
    kinds = F.array_distinct(F.transform("alts", lambda a: kind(a["walk"])))
    ident = F.concat("a_t", "b_t")
    rec = rec.withColumn("vartype", F.when(F.size(kinds) == 1, kinds[0]).otherwise(F.raise_error(F.concat(F.lit("mixed kinds of alleles at one site: "), ident))))
    sub = F.col("vartype") == "SUB"
    before = F.when(sub, "").otherwise(F.col("a_dna"))
    token = F.when(sub, "").otherwise(F.col("a_t"))
    n_ref = F.coalesce(F.size("refs"), F.lit(0))
    rec = rec.withColumn("an", (F.greatest(n_ref, F.lit(0)) + F.aggregate("alts", F.lit(0), lambda n, a: n + F.size(a["paths"]))).cast("bigint"))
    pairs = F.concat(F.transform(F.coalesce("refs", F.array().cast("array<bigint>")), lambda p: F.struct(p.alias("p"), F.lit("0").alias("g"))), F.flatten(F.transform("alts", lambda a, i: F.transform(a["paths"], lambda p: F.struct(p.alias("p"), (i + 1).cast("string").alias("g"))))))
    rec = rec.join(F.broadcast(layout)).withColumn("gts", _cells(F.map_from_entries(pairs), F.col("layout")))
    chrom = paths.where(F.col("path_id") == ref_path).select(F.col("name").alias("chrom"))
    text = lambda f: F.array_join(F.transform("alts", f), ",")
    return rec.join(F.broadcast(chrom)).select(
        "chrom", F.when(sub, F.col("a_locus") + F.length("a_dna")).otherwise(F.col("a_locus")).cast("bigint").alias("pos"), ident.alias("id"),
        F.concat(before, "rdna").alias("ref_seq"), text(lambda a: F.concat(before, a["dna"])).alias("alt"),
        text(lambda a: F.size(a["paths"]).cast("string")).alias("ac"), text(lambda a: shortest(F.size(a["paths"]) / F.col("an"))).alias("af"), "an",
        F.size(F.filter("gts", lambda g: g != ".")).cast("bigint").alias("ns"),
        F.concat_ws(",", F.concat(token, "rwalk"), text(lambda a: F.concat(token, a["walk"]))).alias("at"), "vartype", ident.alias("es"), F.col("level").alias("lv"), "parent", "gts", F.col("a_seg_id").alias("first"), F.col("b_seg_id").alias("last"),
    )


def hairpin_call(steps: DataFrame, segments: DataFrame, paths: DataFrame, ref_path: int) -> DataFrame:
    """The record (RECORD's columns) of the first path that is the reference walked backwards; no row without one.

    Its alleles are both whole paths, its place is that of the second step. The reference's and this path's samples are
    called, all others are missing.
    """
    back = collinear.reverse_paths(steps, ref_path).agg(F.min("path_id").alias("path_id")).where("path_id IS NOT NULL")
    two = F.lit(ref_path).cast("bigint")
    who = back.select(F.explode(F.array(two, F.col("path_id"))).alias("path_id"))
    loci = graphs.with_loci(steps.join(who, "path_id", "left_semi"), segments)
    base = F.when(F.col("strand") == ">", F.col("seq")).otherwise(revcomp(F.col("seq")))
    w = loci.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("step_idx", F.concat("strand", F.col("seg_id").cast("string")).alias("t"), base.alias("b"), "locus", "seg_id"))).alias("w"))
    told = w.select("path_id", F.array_join("w.t", "").alias("walk"), F.array_join("w.b", "").alias("dna"), F.element_at("w", 1).alias("a"), F.element_at("w", -1).alias("z"), F.get("w", F.lit(1))["locus"].alias("second"))
    r = told.where(F.col("path_id") == ref_path).drop("path_id")
    h = told.where(F.col("path_id") != ref_path).select("path_id", F.col("walk").alias("hwalk"), F.col("dna").alias("hdna"))
    m = F.map_from_arrays(F.array(two, F.col("path_id")), F.array(F.lit("0"), F.lit("1")))
    rec = r.join(F.broadcast(h)).join(F.broadcast(sample_layout(paths))).withColumn("gts", _cells(m, F.col("layout")))
    chrom = paths.where(F.col("path_id") == ref_path).select(F.col("name").alias("chrom"))
    none = F.lit(None).cast("string")
    return rec.join(F.broadcast(chrom)).select(
        "chrom", F.coalesce("second", F.lit(1)).cast("bigint").alias("pos"), F.concat(F.col("a.t"), F.col("z.t")).alias("id"), F.col("dna").alias("ref_seq"), F.col("hdna").alias("alt"),
        F.lit("1").alias("ac"), F.lit("0.5").alias("af"), F.lit(2).cast("bigint").alias("an"), F.size(F.filter("gts", lambda g: g != ".")).cast("bigint").alias("ns"), F.concat_ws(",", "walk", "hwalk").alias("at"),
        F.lit("SUBR").alias("vartype"), none.alias("es"), F.lit(None).cast("bigint").alias("lv"), none.alias("parent"), "gts", F.col("a.seg_id").alias("first"), F.col("z.seg_id").alias("last"),
    )


def calls(steps: DataFrame, segments: DataFrame, paths: DataFrame, ref_path: int) -> DataFrame:
    """hairpin_call() alone where a path is the reference walked backwards, else site_calls()."""
    hairpin = written(hairpin_call(steps, segments, paths, ref_path), "hairpin")
    return hairpin if hairpin.take(1) else site_calls(steps, segments, paths, ref_path)


def lines(rec: DataFrame) -> DataFrame:
    """(chrom, pos, id, vartype, first, last, line): the text of calls()."""
    info = F.concat_ws(";", F.concat(F.lit("AC="), "ac"), F.concat(F.lit("AF="), "af"), F.concat(F.lit("AN="), F.col("an").cast("string")), F.concat(F.lit("NS="), F.col("ns").cast("string")), F.concat(F.lit("AT="), "at"), F.concat(F.lit("VARTYPE="), "vartype"), F.lit("TANGLED=F"), F.concat(F.lit("ES="), "es"), F.concat(F.lit("LV="), F.col("lv").cast("string")))
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref_seq", "alt", F.lit("60"), F.lit("PASS"), info, F.lit("GT"), F.array_join("gts", "\t"))
    return rec.select("chrom", "pos", "id", "vartype", "first", "last", line.alias("line"))
