"""Graph: the verbs of the engine over one variation graph held as DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calling, collinear, decompose, graphs, inversions, sites, subbubbles, untangle, validate
from ..sources import gfa, pvst, texts, vcf
from .durable import written


class Graph:
    """segments(seg_id, seq), links(edge_idx, v1, v1_end, v2, v2_end), paths(path_id, name), steps(path_id, step_idx, seg_id, strand).

    Results are lazy DataFrames; what several verbs share (components, the bubble tree) is written once in the folder
    of spark.checkpoint.dir.
    """

    def __init__(self, segments: DataFrame, links: DataFrame, paths: DataFrame, steps: DataFrame):
        self.segments, self.links, self.paths, self.steps = segments, links, paths, steps
        self.spark: SparkSession = segments.sparkSession

    @classmethod
    def load(cls, spark: SparkSession, path: str, check: bool = True) -> Graph:
        return cls.from_lines(gfa.read_lines(spark, path), check)

    @classmethod
    def from_lines(cls, lines: DataFrame, check: bool = True) -> Graph:
        if check:
            gfa.require_valid(lines)
        return cls(gfa.segments(lines), gfa.links(lines), gfa.paths(lines), gfa.steps(lines))

    @classmethod
    def build(cls, spark: SparkSession, segments: list[tuple[int, str]], links: list[tuple[int, str, int, str]], paths: list[tuple[str, list[tuple[int, str]]]] = ()) -> Graph:
        """From vertices, edges by side, and named walks of (segment, > or <)."""
        return cls(
            spark.createDataFrame(segments, "seg_id long, seq string"),
            spark.createDataFrame([(i, *e) for i, e in enumerate(links)], "edge_idx long, v1 long, v1_end string, v2 long, v2_end string"),
            spark.createDataFrame([(i, p[0]) for i, p in enumerate(paths)], "path_id long, name string"),
            spark.createDataFrame([(i, k, s, o) for i, p in enumerate(paths) for k, (s, o) in enumerate(p[1])], "path_id long, step_idx long, seg_id long, strand string"),
        )

    def lines(self, walks=None) -> DataFrame:
        """(line_no, value): the graph as text, see gfa.text()."""
        return gfa.text(self.segments, self.links, self.paths, self.steps, walks)

    @cached_property
    def comps(self) -> DataFrame:
        return written(graphs.components(self.segments, self.links), "comps")

    @cached_property
    def class_stack(self) -> DataFrame:
        return written(decompose.class_stacks(self.links, self.comps), "stack")

    @cached_property
    def _kinds(self) -> DataFrame:
        return written(decompose.stacks_with_families(self.links, self.comps), "kinds")

    @cached_property
    def loci(self) -> DataFrame:
        return written(graphs.with_loci(self.steps, self.segments), "loci")

    def info(self) -> DataFrame:
        return graphs.graph_info(self.segments, self.links)

    def decompose(self, families: bool = False) -> DataFrame:
        """The bubble tree of every component; with families also sym, upper and lower of decompose.families()."""
        if not families:
            return decompose.pvst(self.links, self.comps, self.class_stack)
        return decompose.pvst(self.links, self.comps, self._kinds).join(decompose.families(self._kinds), ["comp_id", "i", "j"])

    @cached_property
    def tree(self) -> DataFrame:
        """decompose() as a written table, for verbs that read it more than once."""
        return written(self.decompose(), "tree")

    @cached_property
    def _bubbles(self) -> DataFrame:
        return written(subbubbles.bubble_nodes(self.links, self.comps), "bubbles")

    def bubbles(self) -> DataFrame:
        """The bubble tree with all kinds of bubbles; see subbubbles.bubble_nodes()."""
        return self._bubbles

    def bubble_lines(self) -> DataFrame:
        """(comp_id, idx, line): bubbles() as the tree's text."""
        return pvst.lines_of(pvst.with_root(self._bubbles))

    def export(self, refs: list[str], apart: bool = False) -> DataFrame:
        """(kind, n, json): graph, bubble tree, class stack and calls, see texts.structure_export()."""
        rec = written(self.call(refs, apart=apart), "records")
        return texts.structure_export(self.segments, self.links, self.paths, self.steps, pvst.with_root(self._bubbles), decompose.next_seen(self.class_stack), rec, calling.genotype_matrix(rec, self.paths))

    def prune(self) -> DataFrame:
        """(comp_id, line): each component's structure as GFA text without sequences."""
        s = self.comps.select("comp_id", F.concat(F.lit("S\t"), F.col("seg_id").cast("string"), F.lit("\tA")).alias("line"))
        sign = lambda a, side: F.when(F.col(a) == side, "+").otherwise("-")
        loop = F.col("v1") == F.col("v2")
        text = F.concat_ws("\t", F.lit("L"), F.col("v1").cast("string"), F.when(loop, "+").otherwise(sign("v1_end", "r")), F.col("v2").cast("string"), F.when(loop, "+").otherwise(sign("v2_end", "l")), F.lit("0M"))
        e = self.links.join(self.comps.select(F.col("seg_id").alias("v1"), "comp_id"), "v1").select("comp_id", text.alias("line"))
        return s.unionByName(e)

    def references(self, prefixes: list[str]) -> DataFrame:
        """(path_id) of the paths that the prefixes choose."""
        p = self.spark.createDataFrame([(x,) for x in prefixes], "prefix string")
        return graphs.select_references(self.paths, p).select("path_id").distinct()

    def _columns(self, called: DataFrame) -> DataFrame:
        cols = written(calling.columns(called, self.links, self.comps), "columns")
        return written(calling.guided(cols, called, self.steps), "guided") if cols.where("cyclic").take(1) else cols

    def call(self, refs: list[str], region: str | None = None, tree: DataFrame | None = None, apart: bool = False) -> DataFrame:
        """records() of the bubbles that all chosen references cross; with apart those of them that enter the component."""
        chosen = self.references(refs)
        called = calling.colour(self.tree if tree is None else tree, self.steps, chosen, self.comps if apart else None)
        if region:
            called = calling.restrict(called, self.loci, self.paths, region)
        cols = self._columns(written(called, "called"))
        seen = written(calling.visits(cols, self.steps), "visits")
        loops = written(calling.tangled(cols, seen), "tangled")
        plain = seen.join(loops, "rov_id", "left_anti")
        anch = written(calling.anchors(plain, chosen), "anchors")
        rec = calling.records(calling.alleles(anch, calling.contexts(anch), self.loci), cols, self.paths)
        if not loops.take(1):
            return rec
        # regions passed more than once: lap by lap
        wound = cols.join(loops, "rov_id")
        laps = written(untangle.region_laps(wound, self.loci), "laps")
        pairs = written(untangle.lap_pairs(untangle.transcripts(laps, chosen)), "pairs")
        cols2, laps2 = (written(x, "unrolled") for x in untangle.unrolled(wound, laps, pairs))
        anch2 = written(calling.anchors(untangle.lap_visits(cols2, laps2), chosen).join(laps2.select("rov_id", "ref").distinct(), ["rov_id", "ref"], "left_semi"), "anchors")
        more = calling.records(calling.alleles(anch2, calling.contexts(anch2), self.loci), cols2, self.paths)
        return rec.unionByName(more)

    def inversions(self, refs: list[str], tree: DataFrame | None = None, apart: bool = False, local: bool = False) -> DataFrame:
        """subr_records() of the bubbles that a haplotype reads backwards as a whole, with local of pieces within them too;
        apart as in call()."""
        chosen = self.references(refs)
        called = calling.colour(self.tree if tree is None else tree, self.steps, chosen, self.comps if apart else None)
        cols = self._columns(written(called, "called"))
        seen = written(calling.visits(cols, self.steps), "visits")
        anch = written(calling.anchors(seen, chosen), "anchors")
        pins = inversions.whole_pins(seen, anch)
        if local:
            pins = pins.unionByName(inversions.local_pins(seen, anch))
        pins = written(inversions.paired(pins, chosen), "pins")
        return inversions.subr_records(written(inversions.stretches(pins, self.steps), "stretches"), self.loci, self.paths)

    def hairpins(self) -> DataFrame:
        return decompose.hairpins(self.links, self.comps)

    def gfa2vcf(self, refs: list[str], region: str | None = None, apart: bool = False) -> DataFrame:
        """(chrom, pos, id, vartype, line) of every call, to be ordered by its first columns; apart as in call()."""
        return calling.vcf_lines(self.call(refs, region, apart=apart), self.paths)

    def write_prune(self, path: str) -> None:
        """prune() as text, a folder per component below path."""
        rows = self.prune().select("comp_id", F.expr("IF(line LIKE 'S%', 0, 1)").alias("k"), F.col("line").alias("value"))
        keys = ("comp_id", "k", "value")
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("comp_id", "value").write.partitionBy("comp_id").text(path)

    def vertices(self) -> DataFrame:
        return self.segments.select("seg_id", "seq")

    def edges(self) -> DataFrame:
        return self.links.select("edge_idx", "v1", "v1_end", "v2", "v2_end")

    def counts(self) -> DataFrame:
        """One row: vertices, edges, paths."""
        one = lambda df, name: df.agg(F.count("*").alias(name))
        return one(self.segments, "vertices").join(one(self.links, "edges")).join(one(self.paths, "paths"))

    def write_vcf(self, prefixes: list[str], path: str, combined: bool = False) -> None:
        """A folder of VCF files per prefix below path, each with its own header; combined: one of all prefixes at path."""
        names = [r[0] for r in graphs.genotype_columns(self.paths).groupBy("hap_col").agg(F.min("sample").alias("s")).orderBy("hap_col").select("s").collect()]
        for chosen in [prefixes] if combined else [[p] for p in prefixes]:
            lengths = graphs.path_lengths(self.steps, self.segments).join(self.references(chosen), "path_id").join(self.paths, "path_id")
            vcf.write(self.gfa2vcf(chosen), vcf.header(names), lengths.select(F.col("path_id").alias("k"), F.col("name").alias("chrom"), F.col("hap_len").alias("length")), path if combined else f"{path}/{chosen[0]}")

    def call_collinear(self, ref: str | None = None) -> DataFrame:
        """Calls without a decomposition, from each path's alignment with one reference path."""
        first = graphs.first_reference(self.paths, ref).first()
        if first is None or first[0] is None:
            raise ValueError(f"no path is called {ref!r}")
        return collinear.collinear_calls(self.steps, self.segments, self.paths, first[0])

    def site_calls(self, ref: str | None = None) -> DataFrame:
        """Records by sample, level and parent from each path's alignment with one reference path; see sites.calls()."""
        first = graphs.first_reference(self.paths, ref).first()
        if first is None or first[0] is None:
            raise ValueError(f"no path is called {ref!r}")
        return sites.calls(self.steps, self.segments, self.paths, first[0])

    def _checked(self, rec: DataFrame) -> tuple[DataFrame, DataFrame]:
        claims = written(validate.claims_of_vcf(rec, self.paths), "claims")
        return claims, written(validate.check_calls(claims.select("claim", "path_id", "at"), self.steps), "checked")

    def validate(self, rec: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(failed records, summary) of sources.vcf.records() against the graph's walks."""
        claims, checked = self._checked(rec)
        return validate.failed_records(claims, checked), validate.report(checked)

    def write_report(self, rec: DataFrame, path: str) -> None:
        """report (a row per failed record, behind its head) and summary as text folders below path."""
        claims, checked = self._checked(rec)
        head = self.spark.createDataFrame([(-1, validate.REPORT_HEAD)], "line_no long, line string")
        rows = head.unionByName(validate.report_lines(rec, claims, checked, self.paths))
        rows.repartitionByRange("line_no").sortWithinPartitions("line_no").select(F.col("line").alias("value")).write.text(f"{path}/report")
        validate.summary_line(validate.report(checked)).select(F.col("line").alias("value")).write.text(f"{path}/summary")
