"""Graph tables: adjacency, tips, components, loci, summaries, reference choice, genotype columns.

Tables (all plain DataFrames):
segments(seg_id, seq)            links(edge_idx, v1, v1_end, v2, v2_end)
paths(path_id, name)             steps(path_id, step_idx, seg_id, strand)   strand is > or <
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import pansn
from ..plans.durable import discard, numbered, written
from ..session import on_workers


#: Steps of a path that are summed up in one task.
STEPS = 1_000_000


def bidirected(links: DataFrame) -> DataFrame:
    """Every link from both of its ends: (edge_idx, seg_id, side, other, other_side)."""
    a = links.select("edge_idx", F.col("v1").alias("seg_id"), F.col("v1_end").alias("side"), F.col("v2").alias("other"), F.col("v2_end").alias("other_side"))
    b = links.where("NOT (v1 = v2 AND v1_end = v2_end)").select("edge_idx", F.col("v2").alias("seg_id"), F.col("v2_end").alias("side"), F.col("v1").alias("other"), F.col("v1_end").alias("other_side"))
    return a.unionByName(b)


def degrees(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(seg_id, deg_l, deg_r) of every segment."""
    d = bidirected(links).groupBy("seg_id").agg(F.sum(F.expr("CAST(side = 'l' AS BIGINT)")).alias("deg_l"), F.sum(F.expr("CAST(side = 'r' AS BIGINT)")).alias("deg_r"))
    return segments.select("seg_id").join(d, "seg_id", "left").select("seg_id", F.coalesce("deg_l", F.lit(0)).alias("deg_l"), F.coalesce("deg_r", F.lit(0)).alias("deg_r"))


def tips(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(seg_id, side) of sides without a link; of an isolated segment the left one alone."""
    d = degrees(segments, links)
    return d.where("deg_l = 0").select("seg_id", F.lit("l").alias("side")).unionByName(d.where("deg_r = 0 AND deg_l > 0").select("seg_id", F.lit("r").alias("side")))


def _forests(it):
    """Each batch of edges (u, v) as edges of its nodes to the smallest node that they reach within the batch."""
    for pdf in it:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            at = x
            while up.setdefault(at, at) != at:
                at = up[at]
            while up[x] != at:
                up[x], x = at, up[x]
            return at

        for u, v in zip(pdf.u.tolist(), pdf.v.tolist()):
            x, y = find(u), find(v)
            if x != y:
                up[max(x, y)] = min(x, y)
        nodes = list(up)
        roots = [find(x) for x in nodes]
        yield pd.DataFrame([(x, r) for x, r in zip(nodes, roots) if x != r], columns=["u", "v"])


def min_labels(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, root) of every node(id): the smallest id that edges(a, b) reach from it.

    Edges are range-sorted and each batch of them is shrunk to a forest of depth one, which shortens long chains of
    neighbouring ids. What forests meet at nodes joins their roots; over these alone large-star and small-star rounds
    alternate, each written durably; their number grows with the logarithm of what diameter is left.
    """
    on_workers(edges.sparkSession)
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = e.repartitionByRange("v", "u").sortWithinPartitions("v", "u").mapInPandas(_forests, "u long, v long")
    e = written(e.distinct(), "forests")
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    met = e.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    met = met.unionByName(low.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u", F.col("m").alias("v")))
    star = star_edges(written(met.distinct(), "star"), max_rounds).select(F.col("u").alias("m"), F.col("v").alias("root"))
    found = low.select(F.col("u").alias("id"), "m").unionByName(star.select(F.col("m").alias("id"), "m")).groupBy("id").agg(F.min("m").alias("m"))
    found = found.join(star, "m", "left").select("id", F.coalesce("root", "m").alias("root"))
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("root", "id").alias("root"))


def star_edges(e: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Edges (u, v), u > v, of a table made by written(), as one edge from every node to the smallest that it reaches."""
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    stamp = mark(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        nxt = written(small.select("x.u", "x.v").where("u <> v").distinct(), "star")
        now = mark(nxt)
        discard(e)
        e = nxt
        if now == stamp:
            return e
        stamp = now
    raise RuntimeError("components did not settle")


def components(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(seg_id, root, comp_id): components numbered from 1 in the order of their smallest segment."""
    nodes = segments.select(F.col("seg_id").alias("id"))
    labels = written(min_labels(nodes, links.select(F.col("v1").alias("a"), F.col("v2").alias("b"))).select(F.col("id").alias("seg_id"), "root"), "labels")
    roots = numbered(labels.where("seg_id = root").select("root"), "root", name="before")
    return labels.join(roots.select("root", (F.col("before") + 1).cast("bigint").alias("comp_id")), "root").select("seg_id", "root", "comp_id")


def graph_info(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(comp_id, vertices, edges, tips) per component."""
    c = written(components(segments, links), "comps").select("seg_id", "comp_id")
    v = c.groupBy("comp_id").agg(F.count("*").alias("vertices"))
    e = links.join(c.withColumnRenamed("seg_id", "v1"), "v1").groupBy("comp_id").agg(F.countDistinct("edge_idx").alias("edges"))
    t = tips(segments, links).join(c, "seg_id").groupBy("comp_id").agg(F.count("*").alias("tips"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return v.join(e, "comp_id", "left").join(t, "comp_id", "left").select("comp_id", "vertices", zero("edges"), zero("tips"))


def with_loci(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """steps with seq and locus: the 1-based place of a step's first base on its path.

    Sums run within blocks of a path's steps and over the blocks' totals before, so a long path is many tasks.
    """
    s = steps.join(segments.select("seg_id", "seq"), "seg_id").withColumn("_b", F.floor(F.col("step_idx") / STEPS))
    total = s.groupBy("path_id", "_b").agg(F.sum(F.length("seq")).alias("_n"))
    upto = Window.partitionBy("path_id").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("path_id", "_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    own = Window.partitionBy("path_id", "_b").orderBy("step_idx").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_own", F.coalesce(F.sum(F.length("seq")).over(own), F.lit(0))).join(total, ["path_id", "_b"])
    return s.select(*steps.columns, "seq", (1 + F.col("_before") + F.col("_own")).cast("bigint").alias("locus"))


def stretches(spans: DataFrame, steps: DataFrame, step: Column) -> DataFrame:
    """spans(path_id, s, e) with w: the array of `step`, a struct that step_idx leads, from the s-th to the e-th step.

    A row per step of each span meets the steps by number, so the work is as large as what it returns. Spans without
    steps (e < s) are left out.
    """
    inside = spans.where("s <= e").withColumn("step_idx", F.explode(F.sequence("s", "e")))
    return inside.join(steps, ["path_id", "step_idx"]).groupBy("path_id", "s", "e").agg(F.sort_array(F.collect_list(step)).alias("w"))


def path_lengths(steps: DataFrame, segments: DataFrame) -> DataFrame:
    """(path_id, n_steps, hap_len)."""
    return steps.join(segments.select("seg_id", F.length("seq").cast("bigint").alias("n")), "seg_id").groupBy("path_id").agg(F.count("*").alias("n_steps"), F.sum("n").alias("hap_len"))


def path_names(paths: DataFrame) -> DataFrame:
    """paths with format, sample, hap_id and contig."""
    p = pansn(F.col("name"))
    return paths.select("path_id", "name", p["format"].alias("format"), p["sample"].alias("sample"), p["hap_id"].alias("hap_id"), p["contig"].alias("contig"))


def select_references(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(path_id, name, prefix): PANSN sample equal to the prefix, RAW sample or any full name starting with it.

    prefixes(prefix) is a short list given by the user.
    """
    p = path_names(paths)
    match = ((F.col("format") == "PANSN") & (F.col("sample") == F.col("prefix"))) | ((F.col("format") == "RAW") & F.startswith("sample", "prefix")) | F.startswith("name", "prefix")
    return p.join(prefixes, match).select("path_id", "name", "prefix")


def first_reference(paths: DataFrame, wanted: str | None) -> DataFrame:
    """(path_id): the first path whose name or sample is wanted or whose name starts with it; path 0 if none is wanted."""
    p = path_names(paths)
    if wanted is None:
        return p.agg(F.min("path_id").alias("path_id"))
    return p.where((F.col("name") == wanted) | (F.col("sample") == wanted) | F.startswith("name", F.lit(wanted))).agg(F.min("path_id").alias("path_id"))


def ploidy(paths: DataFrame) -> DataFrame:
    """(sample, haps, ploidy) of PANSN samples; haps is the sorted list of haplotype numbers as text."""
    p = path_names(paths).where("format = 'PANSN'").groupBy("sample").agg(F.sort_array(F.collect_set("hap_id")).alias("h"))
    return p.select("sample", F.array_join(F.col("h").cast("array<string>"), ",").alias("haps"), F.size("h").cast("bigint").alias("ploidy"))


def genotype_columns(paths: DataFrame) -> DataFrame:
    """(path_id, sample, hap_col, phase): a column per sample in the order of first paths, phases by rank of hap_id."""
    p = path_names(paths)
    cols = numbered(p.groupBy("sample").agg(F.min("path_id").alias("first")), "first", name="hap_col").drop("first")
    # null is a hap_id of its own
    phase = F.dense_rank().over(Window.partitionBy("sample").orderBy("hap_id")) - 1
    cols = p.select("sample", "hap_id").distinct().withColumn("phase", phase.cast("bigint")).join(cols, "sample").withColumn("_h", F.coalesce("hap_id", F.lit(-1))).drop("hap_id")
    return p.withColumn("_h", F.coalesce("hap_id", F.lit(-1))).join(cols, ["sample", "_h"]).select("path_id", "sample", "hap_col", "phase")


def laps(steps: DataFrame, inside: DataFrame) -> DataFrame:
    """(path_id, lap_no, first_step, n): maximal runs of consecutive steps on segments of inside(seg_id)."""
    s = steps.join(inside.select("seg_id").distinct(), "seg_id", "left_semi")
    w = Window.partitionBy("path_id").orderBy("step_idx")
    s = s.withColumn("island", F.col("step_idx") - F.row_number().over(w))
    g = s.groupBy("path_id", "island").agg(F.min("step_idx").alias("first_step"), F.count("*").alias("n"))
    return g.select("path_id", (F.row_number().over(Window.partitionBy("path_id").orderBy("first_step")) - 1).cast("bigint").alias("lap_no"), "first_step", "n")


def zip_positions(steps: DataFrame, u: int, v: int) -> DataFrame:
    """(path_id, rn, lo, hi): the i-th step on u with the i-th on v, in order of place, as far as both go."""
    rank = F.row_number().over(Window.partitionBy("path_id").orderBy("step_idx"))
    a = steps.where(F.col("seg_id") == u).select("path_id", F.col("step_idx").alias("i"), rank.alias("rn"))
    b = steps.where(F.col("seg_id") == v).select("path_id", F.col("step_idx").alias("j"), rank.alias("rn"))
    return a.join(b, ["path_id", "rn"]).select("path_id", F.col("rn").cast("bigint").alias("rn"), F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))


def depth(steps: DataFrame, cols: DataFrame) -> DataFrame:
    """(rov_id, path_id, col, times, code) where a path visits a column: code 1 or 2 for one forward or reverse visit, else times."""
    g = steps.join(cols.select("rov_id", "col", "seg_id"), "seg_id").groupBy("rov_id", "path_id", "col").agg(F.count("*").alias("times"), F.min("strand").alias("strand"))
    return g.select("rov_id", "path_id", "col", "times", F.when(F.col("times") > 1, F.col("times")).when(F.col("strand") == ">", 1).otherwise(2).cast("bigint").alias("code"))


def unsupported_steps(steps: DataFrame, links: DataFrame) -> DataFrame:
    """(path_id, step_idx): steps whose next step no link joins."""
    w = Window.partitionBy("path_id").orderBy("step_idx")
    nxt = steps.select("path_id", "step_idx", "seg_id", F.expr("IF(strand = '>', 'r', 'l')").alias("side"), F.lead("seg_id").over(w).alias("other"), F.expr("IF(lead(strand) OVER (PARTITION BY path_id ORDER BY step_idx) = '>', 'l', 'r')").alias("other_side")).where("other IS NOT NULL")
    return nxt.join(bidirected(links), ["seg_id", "side", "other", "other_side"], "left_anti").select("path_id", "step_idx")
