"""Variant calls: which bubbles to call, their columns, haplotype overlay, alleles, counts, genotypes.

The overlay is sparse and relational. A haplotype has a row per column of a region that it visits. Two haplotypes'
shared columns with equal or inverted codes are anchors; between consecutive anchors they differ exactly where either
visits a column in between, which the rows' ranks tell without looking at the columns themselves.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import flip_walk, revcomp, walk_to_string
from ..plans.durable import written
from ..session import on_workers
from . import decompose, graphs
from .grouped import adjacency, by_key, packed

#: Steps of a path that meet its laps at a time.
LAP_BLOCK = 4096


def colour(tree: DataFrame, steps: DataFrame, refs: DataFrame, comps: DataFrame | None = None) -> DataFrame:
    """Rows of the bubble tree to call: all refs(path_id) visit both ends, and no child is to be called itself.

    refs is the user's choice of paths. With comps each component is held against those of them alone that enter it, so
    that references of several contigs can be chosen together.
    """
    seen = steps.join(refs.select("path_id").distinct(), "path_id").select("path_id", "seg_id").distinct()
    ends = tree.select("comp_id", "i", "j", F.col("start_id").alias("seg_id"), "end_id").join(seen, "seg_id").select("comp_id", "i", "j", "path_id", F.col("end_id").alias("seg_id")).join(seen, ["path_id", "seg_id"])
    hit = ends.groupBy("comp_id", "i", "j").agg(F.countDistinct("path_id").alias("c"))
    if comps is None:
        hit = hit.where(F.col("c") == refs.select("path_id").distinct().count())
    else:
        hit = hit.join(seen.join(comps, "seg_id").groupBy("comp_id").agg(F.countDistinct("path_id").alias("n")), "comp_id").where("c = n")
    hit = written(hit.select("comp_id", "i", "j"), "hit")
    chosen = tree.join(hit, ["comp_id", "i", "j"])
    parents = chosen.where("parent_lo IS NOT NULL").select("comp_id", F.col("parent_lo").alias("i"), F.col("parent_hi").alias("j")).distinct()
    return chosen.join(parents, ["comp_id", "i", "j"], "left_anti")


def parse_region(text: str) -> tuple[str, int, int]:
    """(reference, start, end) of ref:start-end, half open; anything else raises ValueError."""
    ref, colon, span = text.partition(":")
    lo, dash, hi = span.partition("-")
    if not ref or not colon or not dash or not lo.isdigit() or not hi.isdigit() or int(lo) >= int(hi):
        raise ValueError(f"not a region: {text!r}")
    return ref, int(lo), int(hi)


def restrict(called: DataFrame, loci: DataFrame, paths: DataFrame, region: str) -> DataFrame:
    """Rows with a start or end on the named path whose locus lies in the region."""
    ref, lo, hi = parse_region(region)
    on = loci.join(paths.where(F.col("name") == ref).select("path_id"), "path_id").where((F.col("locus") >= lo) & (F.col("locus") < hi)).select("seg_id").distinct()
    a = called.join(on.withColumnRenamed("seg_id", "start_id"), "start_id", "left_semi")
    b = called.join(on.withColumnRenamed("seg_id", "end_id"), "end_id", "left_semi")
    return a.select(*called.columns).unionByName(b.select(*called.columns)).distinct()


def column_order(near: dict, start: tuple[str, int], end: tuple[str, int]) -> tuple[list[int], bool]:
    """Segments between two oriented ends in topological order, or as found breadth first and True if they lie on a cycle."""
    kind: dict[int, str] = {start[1]: start[0]}
    edges: dict[int, list[int]] = {}
    todo = deque([start[1]])
    found = [start[1]]
    while todo:
        u = todo.popleft()
        edges.setdefault(u, [])
        for other, side in near.get((u, "r" if kind[u] == ">" else "l"), ()):
            o = ">" if side == "l" else "<"
            if other not in kind:
                if u == end[1]:
                    continue
                kind[other] = o
                found.append(other)
                todo.append(other)
            elif kind[other] != o:
                continue
            if other not in edges[u]:
                edges[u].append(other)
    degree = dict.fromkeys(kind, 0)
    for outs in edges.values():
        for x in outs:
            degree[x] += 1
    if degree[start[1]]:
        return found, True
    ready, order = deque([start[1]]), []
    while ready:
        u = ready.popleft()
        order.append(u)
        for x in edges[u]:
            degree[x] -= 1
            if not degree[x]:
                ready.append(x)
    return (order, False) if len(order) == len(found) else (found, True)


def lap_order(laps: list[list[int]]) -> list[int]:
    """Segments in an order that laps between the same two segments agree on as far as they can.

    The first lap gives the order. What a later one adds stands before the next known segment of that lap, or before the
    last known one where the order has that later.
    """
    order = list(dict.fromkeys(laps[0])) if laps else []
    for lap in laps[1:]:
        place = {s: k for k, s in enumerate(order)}
        if place.keys() >= set(lap):
            continue
        ahead, right = {}, lap[-1]
        for s in reversed(lap):
            right = s if s in place else right
            ahead.setdefault(s, right)
        added: dict[int, list[int]] = {}
        left, told = lap[0], set()
        for s in lap:
            if s in place:
                left = s
            elif s not in told:
                told.add(s)
                added.setdefault(ahead[s] if place[left] < place[ahead[s]] else left, []).append(s)
        order = [x for s in order for x in (*added.get(s, ()), s)]
    return order


def columns(called: DataFrame, links: DataFrame, comps: DataFrame, min_columns: int = 3) -> DataFrame:
    """(comp_id, i, j, label, height, col, seg_id, cyclic, rov_id) of the regions with at least min_columns segments."""
    end = lambda c: F.expr(f"CAST({c} = '>' AS BIGINT)")  # noqa: E731  a region goes on at the right of a segment read forwards
    r = called.select("comp_id", F.lit(0).cast("bigint").alias("is_link"), F.col("i").alias("edge_idx"), F.col("start_id").alias("v1"), end("start_or").alias("e1"), F.col("end_id").alias("v2"), end("end_or").alias("e2"))
    e = decompose.numbered_links(links, comps).join(called.select("comp_id").distinct(), "comp_id", "left_semi")

    def kernel(is_link, *rest):
        link, region = is_link == 1, is_link == 0
        near = _Near(*(x[link] for x in rest))
        told, cols, segs, loops = array("q"), array("q"), array("q"), []
        for i, a, x, b, y in zip(*(x[region].tolist() for x in rest)):
            order, cyclic = column_order(near, ("<>"[x], a), ("<>"[y], b))
            if len(order) >= min_columns:
                told.extend([i] * len(order))
                cols.extend(range(len(order)))
                segs.extend(order)
                loops += [cyclic] * len(order)
        return told, cols, segs, loops

    out = by_key(r.unionByName(e), kernel, "comp_id long, i long, col long, seg_id long, cyclic boolean")
    of = called.select("comp_id", "i", "j", "label", F.col("height").cast("bigint").alias("height"))
    return out.join(of, ["comp_id", "i"]).select("comp_id", "i", "j", "label", "height", "col", "seg_id", "cyclic", F.concat_ws(":", "comp_id", "i").alias("rov_id"))


class _Near:
    """What the links of a component join to a segment's side, by their numbers; asked as a dictionary is."""

    def __init__(self, idx: np.ndarray, a: np.ndarray, ea: np.ndarray, b: np.ndarray, eb: np.ndarray):
        seg = np.unique(np.concatenate((a, b)))
        self.seg = packed(seg)
        self.start, self.other, _ = adjacency(seg, idx, a, ea, b, eb)

    def get(self, key: tuple[int, str], none: tuple = ()) -> list[tuple[int, str]] | tuple:
        k = bisect_left(self.seg, key[0])
        if k == len(self.seg) or self.seg[k] != key[0]:
            return none
        s = 2 * k + (key[1] == "r")
        return [(self.seg[o >> 1], "lr"[o & 1]) for o in self.other[self.start[s] : self.start[s + 1]]]


def guided(cols: DataFrame, called: DataFrame, steps: DataFrame, min_columns: int = 3) -> DataFrame:
    """cols with the segments of cyclic regions in lap_order() of the haplotypes' laps, and without those off all laps.

    A lap runs from a path's n-th step on one end to its n-th on the other. Laps are cut out of the steps in blocks, and
    equal ones count once; a region's different laps are ordered in one task. Regions that no path passes stay as they are.
    """
    on_workers(cols.sparkSession)
    ends = cols.where("cyclic AND col = 0").select("rov_id", "comp_id", "i", "j").join(called.select("comp_id", "i", "j", "start_id", "end_id"), ["comp_id", "i", "j"])
    nth = F.row_number().over(Window.partitionBy("rov_id", "path_id").orderBy("step_idx"))
    on = lambda end, name: ends.select("rov_id", F.col(end).alias("seg_id")).join(steps, "seg_id").select("rov_id", "path_id", F.col("step_idx").alias(name), nth.alias("n"))
    block = lambda c: F.floor(F.col(c) / LAP_BLOCK)
    laps = on("start_id", "a").join(on("end_id", "b"), ["rov_id", "path_id", "n"]).select("rov_id", "path_id", "n", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    inside = laps.withColumn("_b", F.explode(F.sequence(block("lo"), block("hi")))).join(steps.select("path_id", "step_idx", "seg_id", block("step_idx").alias("_b")), ["path_id", "_b"]).where("step_idx BETWEEN lo AND hi")
    walks = inside.groupBy("rov_id", "path_id", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("step_idx", "seg_id"))), lambda x: x["seg_id"]).alias("lap"))
    walks = written(walks.groupBy("rov_id", "lap").agg(F.min(F.struct("path_id", "n")).alias("f")).select("rov_id", "lap", "f.path_id", "f.n"), "laps")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = lap_order([list(x) for x in pdf.sort_values(["path_id", "n"]).lap])
        order = order if len(order) >= min_columns else []
        return pd.DataFrame({"rov_id": pdf.rov_id.iloc[0], "col": range(len(order)), "seg_id": order}).astype({"col": "int64", "seg_id": "int64"})

    found = walks.groupBy("rov_id").applyInPandas(run, "rov_id string, col long, seg_id long").join(cols.where("col = 0").drop("col", "seg_id"), "rov_id")
    return cols.join(walks.select("rov_id").distinct(), "rov_id", "left_anti").select(*cols.columns).unionByName(found.select(*cols.columns))


def visits(cols: DataFrame, steps: DataFrame) -> DataFrame:
    """(rov_id, path_id, col, code, first_step, last_step, rn): a row per column that a haplotype visits, ranked by column."""
    return visited(steps.join(cols.select("rov_id", "col", "seg_id"), "seg_id"))


def visited(inside: DataFrame) -> DataFrame:
    """visits() of steps that already carry their region and column."""
    g = inside.groupBy("rov_id", "path_id", "col").agg(F.count("*").alias("times"), F.min("strand").alias("strand"), F.min("step_idx").alias("first_step"), F.max("step_idx").alias("last_step"))
    code = F.when(F.col("times") > 1, F.col("times") + 2).when(F.col("strand") == ">", 1).otherwise(2)
    return g.select("rov_id", "path_id", "col", code.cast("bigint").alias("code"), "times", "first_step", "last_step", F.row_number().over(Window.partitionBy("rov_id", "path_id").orderBy("col")).alias("rn"))


def tangled(cols: DataFrame, seen: DataFrame) -> DataFrame:
    """(rov_id) of regions where a haplotype visits the first or last column more than once."""
    ends = cols.groupBy("rov_id").agg(F.max("col").alias("top"))
    return seen.join(ends, "rov_id").where("times > 1 AND (col = 0 OR col = top)").select("rov_id").distinct()


def anchors(seen: DataFrame, refs: DataFrame) -> DataFrame:
    """Shared columns of each called reference with each haplotype (itself too) whose codes are equal or inverted.

    (rov_id, ref, hap, col, eq, rr, hr, ce, and both haplotypes' first and last steps); rr and hr rank the column
    among those that the one and the other visit, ce counts equal codes up to here.
    """
    r = seen.join(refs.select("path_id").distinct(), "path_id").select("rov_id", "col", F.col("path_id").alias("ref"), F.col("code").alias("rc"), F.col("rn").alias("rr"), F.col("first_step").alias("rf"), F.col("last_step").alias("rl"))
    h = seen.select("rov_id", "col", F.col("path_id").alias("hap"), F.col("code").alias("hc"), F.col("rn").alias("hr"), F.col("first_step").alias("hf"), F.col("last_step").alias("hl"))
    a = r.join(h, ["rov_id", "col"]).where("rc = hc OR (rc IN (1, 2) AND hc IN (1, 2))")
    w = Window.partitionBy("rov_id", "ref", "hap").orderBy("col")
    return a.withColumn("eq", F.expr("CAST(rc = hc AS INT)")).withColumn("ce", F.sum("eq").over(w))


def contexts(anch: DataFrame) -> DataFrame:
    """(rov_id, ref, hap, u, v): consecutive anchors between which the two differ."""
    w = Window.partitionBy("rov_id", "ref", "hap").orderBy("col")
    nxt = anch.where("ref <> hap").withColumn("v", F.lead("col").over(w)).withColumn("rr2", F.lead("rr").over(w)).withColumn("hr2", F.lead("hr").over(w))
    return nxt.where("v IS NOT NULL AND (rr2 - rr > 1 OR hr2 - hr > 1)").select("rov_id", "ref", "hap", F.col("col").alias("u"), "v")


def alleles(anch: DataFrame, ctx: DataFrame, loci: DataFrame) -> DataFrame:
    """The allele of each haplotype in each context: (rov_id, ref, u, v, hap, is_ref, type, walk, dna, at, pos, id).

    is_ref: its columns in the context and its walk equal the reference's. type by number of steps: SUB, INS, DEL;
    INV where its walk is the reference's backwards, which is left to inversion calling. Only the steps between the two
    ends of a context are read, once for each different stretch of a path.
    """
    seats = ctx.select("rov_id", "ref", "u", "v").distinct()
    end = lambda c: anch.select("rov_id", "ref", "hap", F.col("col").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("eq", "rr", "hr", "ce", "rf", "rl", "hf", "hl")))
    both = seats.join(end("u"), ["rov_id", "ref", "u"]).join(end("v"), ["rov_id", "ref", "hap", "v"])
    same = (F.col("eq_u") == 1) & (F.col("eq_v") == 1) & (F.col("rr_v") - F.col("rr_u") == F.col("hr_v") - F.col("hr_u")) & (F.col("ce_v") - F.col("ce_u") == F.col("rr_v") - F.col("rr_u"))
    both = both.join(ctx.withColumn("alt", F.lit(True)), ["rov_id", "ref", "hap", "u", "v"], "left").withColumn("same", same).where("same OR alt")
    span = lambda f, l, f2, l2: (F.when(F.col(f) <= F.col(l2), F.col(f)).otherwise(F.col(f2)), F.when(F.col(f) <= F.col(l2), F.col(l2)).otherwise(F.col(l)))  # noqa: E731, E741
    (rs, re), (hs, he) = span("rf_u", "rl_u", "rf_v", "rl_v"), span("hf_u", "hl_u", "hf_v", "hl_v")
    both = written(both.select("rov_id", "ref", "u", "v", "hap", "same", rs.alias("rs"), re.alias("re"), hs.alias("hs"), he.alias("he")), "seats")
    spans = both.select(F.col("ref").alias("path_id"), F.col("rs").alias("s"), F.col("re").alias("e")).union(both.select("hap", "hs", "he")).distinct()
    step = F.struct("step_idx", F.col("strand").alias("orient"), "seg_id", "locus", "seq")
    told = written(graphs.stretches(spans, loci, step), "spans")
    side = lambda path, s, e, name: told.select(F.col("path_id").alias(path), F.col("s").alias(s), F.col("e").alias(e), F.col("w").alias(name))
    both = both.join(side("ref", "rs", "re", "rw"), ["ref", "rs", "re"]).join(side("hap", "hs", "he", "hw"), ["hap", "hs", "he"])
    plain = lambda w: F.transform(w, lambda x: F.struct(x["orient"].alias("orient"), x["seg_id"].alias("seg_id")))
    both = both.withColumn("rwalk", plain("rw")).withColumn("walk", plain("hw")).withColumn("n", F.size("rw")).withColumn("m", F.size("hw"))
    is_ref = F.col("same") & (F.col("rwalk") == F.col("walk"))
    # inverted anchors read a haplotype backwards; the allele is told in its own direction
    kind = F.when(is_ref, "REF").when(F.col("walk") == flip_walk(F.col("rwalk")), "INV").when(F.col("m") == F.col("n"), "SUB").when(F.col("m") > F.col("n"), "INS").otherwise("DEL")
    both = both.withColumn("type", kind).where("type = 'REF' OR walk <> rwalk")
    base = lambda x: F.when(x["orient"] == ">", x["seq"]).otherwise(revcomp(x["seq"]))
    inner = lambda w: F.array_join(F.transform(F.slice(w, F.lit(2), F.greatest(F.lit(0), F.size(w) - 2)), base), "")
    last = lambda w: F.right(base(F.element_at(w, 1)), F.lit(1))
    ident = F.concat(F.element_at("rwalk", 1)["orient"], F.element_at("rwalk", 1)["seg_id"].cast("string"), F.element_at("rwalk", -1)["orient"], F.element_at("rwalk", -1)["seg_id"].cast("string"))
    return both.select("rov_id", "ref", "u", "v", "hap", "type", "walk", "rwalk", ident.alias("id"), F.element_at("rw", 2)["locus"].alias("second"), inner("rw").alias("r_inner"), last("rw").alias("r_last"), inner("hw").alias("h_inner"), last("hw").alias("h_last"))


def _at(walk, kind):
    """Steps as AT tells them: a SUB without both ends, an INS or DEL without its last."""
    short = F.when(kind == "SUB", F.slice(walk, F.lit(2), F.greatest(F.lit(0), F.size(walk) - 2))).otherwise(F.slice(walk, F.lit(1), F.size(walk) - 1))
    return walk_to_string(short)


def records(al: DataFrame, cols: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per context and type: chrom, pos, id, ref, alt, ac, an, af, ns, at, vartype, es, lv and alts.

    alts lists (walk, haplotypes) in ALT order; refs the haplotypes that match. ac, af, alt and at are texts in the form
    of VCF; an and ns are numbers.
    """
    key = ["rov_id", "ref", "u", "v"]
    gt = graphs.genotype_columns(paths).select(F.col("path_id").alias("hap"), "hap_col", "phase")
    al = written(al.join(gt, "hap"), "alleles")
    member = F.struct("hap_col", "phase")
    match = al.where("type = 'REF'").groupBy(*key).agg(F.collect_list(member).alias("refs"))
    k = F.col("type")
    dna = lambda i, l: F.when(k == "SUB", F.col(i)).otherwise(F.concat(l, i))  # noqa: E731, E741
    groups = al.where("type IN ('SUB', 'INS', 'DEL')").groupBy(*key, "type", "id", "second", "rwalk", dna("r_inner", "r_last").alias("ref_dna"), "walk", dna("h_inner", "h_last").alias("alt_dna")).agg(F.collect_list(member).alias("haps"))
    alt = F.struct(F.transform("walk", lambda x: F.struct(x["seg_id"].alias("s"), x["orient"].alias("o"))).alias("order"), F.col("alt_dna").alias("dna"), _at(F.col("walk"), k).alias("at"), F.size("haps").cast("bigint").alias("ac"), "haps")
    rec = groups.groupBy(*key, "type", "id", "second", "rwalk", "ref_dna").agg(F.sort_array(F.collect_list(alt)).alias("alts"))
    info = cols.where("col = 0").select("rov_id", F.col("label").alias("es"), (F.col("height") - 1).alias("lv"))
    rec = rec.join(match, key, "left").join(info, "rov_id").join(paths.select(F.col("path_id").alias("ref"), F.col("name").alias("chrom")), "ref")
    refs = F.coalesce("refs", F.array().cast("array<struct<hap_col:bigint,phase:bigint>>"))
    an = F.size(refs) + F.aggregate("alts", F.lit(0).cast("bigint"), lambda n, x: n + x["ac"])
    everyone = F.flatten(F.concat(F.array(refs), F.transform("alts", lambda x: x["haps"])))
    out = rec.withColumn("an", an.cast("bigint")).withColumn("ns", F.size(F.array_distinct(F.transform(everyone, lambda x: x["hap_col"]))).cast("bigint"))
    text = lambda f: F.array_join(F.transform("alts", f), ",")
    return out.select(
        *key,
        "chrom",
        (F.col("second") - F.expr("IF(type = 'SUB', 0, 1)")).cast("bigint").alias("pos"),
        "id",
        F.col("ref_dna").alias("ref_seq"),
        text(lambda x: x["dna"]).alias("alt"),
        text(lambda x: x["ac"].cast("string")).alias("ac"),
        text(lambda x: (x["ac"] / F.col("an")).cast("string")).alias("af"),
        "an",
        "ns",
        F.concat_ws(",", _at(F.col("rwalk"), k), text(lambda x: x["at"])).alias("at"),
        F.col("type").alias("vartype"),
        F.when(F.contains("rov_id", F.lit("#")), "T").otherwise("F").alias("tangled"),
        "es",
        F.col("lv").cast("bigint").alias("lv"),
        refs.alias("refs"),
        F.transform("alts", lambda x: x["haps"]).alias("alts"),
    )


def genotypes(rec: DataFrame, *more: str) -> DataFrame:
    """(rov_id, ref, u, v, vartype, hap_col, phase, allele): one row per called haplotype, with more columns of its record; 0 is the reference allele."""
    key = ["rov_id", "ref", "u", "v", "vartype", *more]
    return rec.select(*key, F.explode(_called()).alias("x")).select(*key, F.col("x.m.hap_col").alias("hap_col"), F.col("x.m.phase").alias("phase"), F.col("x.allele").alias("allele"))


def _called():
    """A record's haplotypes with their alleles, as an array of (m, allele)."""
    told = lambda haps, allele: F.transform(haps, lambda m: F.struct(m.alias("m"), allele.cast("bigint").alias("allele")))
    return F.concat(told("refs", F.lit(0)), F.flatten(F.transform("alts", lambda haps, k: told(haps, k + 1))))


def with_genotypes(rec: DataFrame, paths: DataFrame) -> DataFrame:
    """rec with gts, one text per sample column; phases joined by |, all missing as a full stop. A record tells its own, so rows stay where they are."""
    width = graphs.genotype_columns(paths).groupBy("hap_col").agg((F.max("phase") + 1).alias("phases"))
    width = width.agg(F.transform(F.sort_array(F.collect_list(F.struct("hap_col", "phases"))), lambda x: x["phases"]).alias("_phases"))
    of = lambda c, p: F.struct(c.cast("bigint").alias("hap_col"), p.alias("phase"))
    cells = lambda n, c: F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda p: F.coalesce(F.element_at("_m", of(c, p)).cast("string"), F.lit(".")))
    gts = F.transform(F.transform("_phases", cells), lambda x: F.when(F.exists(x, lambda y: y != "."), F.array_join(x, "|")).otherwise("."))
    return rec.join(F.broadcast(width)).withColumn("_m", F.map_from_entries(_called())).withColumn("gts", gts).drop("_m", "_phases")


def genotype_matrix(rec: DataFrame, paths: DataFrame) -> DataFrame:
    """(rov_id, ref, u, v, vartype, gts) of with_genotypes()."""
    return with_genotypes(rec, paths).select("rov_id", "ref", "u", "v", "vartype", "gts")


def vcf_lines(rec: DataFrame, paths: DataFrame) -> DataFrame:
    """(chrom, pos, id, vartype, line): the text of each record with its genotypes."""
    r = with_genotypes(rec, paths)
    info = F.concat(F.lit("AC="), "ac", F.lit(";AF="), "af", F.lit(";AN="), F.col("an").cast("string"), F.lit(";NS="), F.col("ns").cast("string"), F.lit(";AT="), "at", F.lit(";VARTYPE="), "vartype", F.lit(";TANGLED="), "tangled", F.lit(";ES="), "es", F.lit(";LV="), F.col("lv").cast("string"))
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "id", "ref_seq", "alt", F.lit("60"), F.lit("PASS"), info, F.lit("GT"), F.array_join("gts", "\t"))
    return r.select("chrom", "pos", "id", "vartype", line.alias("line"))
