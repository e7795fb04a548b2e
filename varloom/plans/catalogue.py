"""Registered queries of the engine, each with SQL that says the same of the tables by another way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import calling, collinear, decompose, graphs, inversions, profiles, validate, views
from ..session import on_workers
from ..sources import gfa, pvst, texts, vcf
from . import structures, synth
from .durable import written

#: Small graphs and call sets, of which queries take a copy per supplier. Fixed values.
NESTED = [
    "H\tVN:Z:1.0",
    "S\t0\tA",
    "S\t1\tC",
    "S\t2\tG",
    "S\t3\tT",
    "S\t4\tC",
    "S\t5\tA",
    "L\t0\t+\t1\t+\t0M",
    "L\t0\t+\t2\t+\t0M",
    "L\t1\t+\t3\t+\t0M",
    "L\t1\t+\t4\t+\t0M",
    "L\t3\t+\t4\t+\t0M",
    "L\t4\t+\t5\t+\t0M",
    "L\t2\t+\t5\t+\t0M",
    "P\tHG1#1#chr1\t0+,1+,3+,4+,5+\t*",
    "P\tHG2#1#chr1\t0+,1+,4+,5+\t*",
    "W\tHG3\t1\tchr1\t0\t3\t>0>2>5",
]
RAW = [
    "HG1#1#chr1\t1\t>0>5\tAAAAA\tA\t60\tPASS\tAC=1;AF=0.3333333333333333;AN=3;NS=3;AT=>0>1>2>3>4,>0;VARTYPE=DEL;TANGLED=T;ES=>0>5;LV=0\tGT\t0\t1\t0",
    "HG1#1#chr1\t3\t>2>4\tA\tG\t60\tPASS\tAC=1;AF=0.5;AN=2;NS=2;AT=>3,>6;VARTYPE=SUB;TANGLED=F;ES=>2>4;LV=1\tGT\t0\t.\t1",
]
TANDEM = [
    "HG1#1#chr1\t4\t>3>5\tAA\tA\t60\tPASS\tAC=1;AF=0.3333333333333333;AN=3;NS=3;AT=>3>4,>3;VARTYPE=DEL;TANGLED=F;ES=>3>5;LV=0\tGT\t0\t1\t0",
    "HG1#1#chr1\t4\t>3>4\tA\tAA\t60\tPASS\tAC=1;AF=0.3333333333333333;AN=3;NS=3;AT=>3,>3>6;VARTYPE=INS;TANGLED=F;ES=>3>4;LV=0\tGT\t0\t0\t1",
]
COMPLEX = [
    "HG1#1#chr1\t10\t>9>14\tACGT\tATGA,ACGTACTACGTACGTA\t60\tPASS\tAC=1,1;AF=0.3333333333333333,0.3333333333333333;AN=3;NS=3;AT=>9>10>11>12,>9>20>11>21,>9>30>31>32;VARTYPE=SUB;TANGLED=T;ES=>9>14;LV=0\tGT\t0\t1\t2",
    "ref\t2\t>1>5\tACGTA\tTACGT\t60\tPASS\tAC=1;AF=0.5;AN=2;NS=2;AT=>1>2>3>4>5,<5<4<3<2<1;VARTYPE=SUBR;TANGLED=F\tGT\t0\t1",
]
BAD_RECORDS = [
    "c\t0\t>1>2\tA\tC\t60\tPASS\tAC=1;AF=0.5;AN=0;NS=2;AT=>1;VARTYPE=SUB\tGT\t0\t7\t.",
    "HG1#1#chr1\t9\t>2>4\tA\tT\t60\tPASS\tAC=1;AF=1;AN=1;NS=1;AT=>1,>2;VARTYPE=SUB\tGT\t.\t.\t1",
    "c\t3\t>8>9\tA\tT\t60\tPASS\tAC=1;AF=1;AN=1;NS=1;AT=>1,>2;VARTYPE=ODD\tGT\t.\t.\t1",
]
HAIRPIN = [
    "S\t1\tA",
    "S\t2\tC",
    "S\t3\tG",
    "S\t4\tT",
    "S\t5\tA",
    "L\t1\t+\t2\t+\t0M",
    "L\t2\t+\t3\t+\t0M",
    "L\t3\t+\t4\t+\t0M",
    "L\t4\t+\t5\t+\t0M",
    "L\t1\t+\t5\t+\t0M",
    "L\t5\t-\t4\t-\t0M",
    "L\t4\t-\t3\t-\t0M",
    "L\t3\t-\t2\t-\t0M",
    "L\t2\t-\t1\t-\t0M",
    "P\tref\t1+,2+,3+,4+,5+\t*",
    "P\talt\t5-,4-,3-,2-,1-\t*",
]
#: What the rewritten call sets of the rows above are. Fixed values.
TOP_LINES = ["HG1#1#chr1\t1\t>0>5:top\tAAAAA\tA\t60\tPASS\tAC=1;AF=0.3333333333333333;AN=3;NS=3;AT=>0>1>2>3>4,>0;VARTYPE=DEL;TANGLED=T;ES=>0>5;LV=0;ORIGIN=>0>5;PROFILE=top-level-only;PASSTHROUGH=T\tGT\t0\t1\t0"]
POPPED_LINES = ["HG1#1#chr1\t3\t>2>4:rescued\tA\tG\t60\tPASS\tAC=1;AF=0.5;AN=2;NS=2;AT=>3,>6;VARTYPE=SUB;TANGLED=F;ES=>2>4;LV=1;ORIGIN=>2>4;PARENT=>0>5;PROFILE=popped;RESCUED_CHILD=T;POPPED_PARENT=>0>5\tGT\t0\t.\t1"]
NORM_LINES = [
    "HG1#1#chr1\t1\t>3>5:norm\tAA\tA\t60\tPASS\tAC=1;AF=0.3333333333333333;AN=3;NS=3;AT=>3>4,>3;VARTYPE=DEL;TANGLED=F;ES=>3>5;LV=0;ORIGIN=>3>5;RAW_ALT_INDEX=1;PROFILE=left-normalized;LEFT_NORMALIZED=T;RAW_POS=4;RAW_REF=AA;RAW_ALT=A\tGT\t0\t1\t0",
    "HG1#1#chr1\t1\t>3>4:norm\tA\tAA\t60\tPASS\tAC=1;AF=0.3333333333333333;AN=3;NS=3;AT=>3,>3>6;VARTYPE=INS;TANGLED=F;ES=>3>4;LV=0;ORIGIN=>3>4;RAW_ALT_INDEX=1;PROFILE=left-normalized;LEFT_NORMALIZED=T;RAW_POS=4;RAW_REF=A;RAW_ALT=AA\tGT\t0\t0\t1",
]
DECOMPOSED_LINES = [
    "HG1#1#chr1\t11\t>9>14:1:snp1\tC\tT\t60\tPASS\tAC=1;AF=0.5;AN=2;NS=2;AT=>10,>20;VARTYPE=SUB;TANGLED=F;ORIGIN=>9>14;RAW_ALT_INDEX=1;PROFILE=decomposed;DECOMPOSED=T;RAW_POS=10;RAW_REF=ACGT;RAW_ALT=ATGA\tGT\t0\t1\t.",
    "HG1#1#chr1\t13\t>9>14:1:snp2\tT\tA\t60\tPASS\tAC=1;AF=0.5;AN=2;NS=2;AT=>12,>21;VARTYPE=SUB;TANGLED=F;ORIGIN=>9>14;RAW_ALT_INDEX=1;PROFILE=decomposed;DECOMPOSED=T;RAW_POS=10;RAW_REF=ACGT;RAW_ALT=ATGA\tGT\t0\t1\t.",
    "HG1#1#chr1\t10\t>9>14:2:passthrough\tACGT\tACGTACTACGTACGTA\t60\tPASS\tAC=1;AF=0.5;AN=2;NS=2;AT=>9>10>11>12,>9>30>31>32;VARTYPE=SUB;TANGLED=T;ORIGIN=>9>14;RAW_ALT_INDEX=2;PROFILE=decomposed;PASSTHROUGH=T;PASS_THROUGH_REASON=max_allele_length;RAW_POS=10;RAW_REF=ACGT;RAW_ALT=ACGTACTACGTACGTA\tGT\t0\t.\t1",
    "ref\t2\t>1>5:subr-passthrough\tACGTA\tTACGT\t60\tPASS\tAC=1;AF=0.5;AN=2;NS=2;AT=>1>2>3>4>5,<5<4<3<2<1;VARTYPE=SUBR;TANGLED=F;ORIGIN=>1>5;RAW_ALT_INDEX=1;PROFILE=decomposed;PASSTHROUGH=T;PASS_THROUGH_REASON=subr_inversion_preservation;SUBR_ORIGIN=T\tGT\t0\t1",
]


def lines_of(spark: SparkSession, text: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text)), gfa.LINES)


def _named(spark: SparkSession, d: str) -> DataFrame:
    """(path_id, name) of suppliers: four of seven names tell sample, haplotype and contig, one does nearly."""
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    of = F.col("s_suppkey") % 7
    name = F.when(of < 4, F.concat(F.lit("HG"), n, F.lit("#"), (F.col("s_suppkey") % 3).cast("string"), F.lit("#chr"), (F.col("s_suppkey") % 5).cast("string"))).when(of == 4, F.concat(F.lit("ref"), k)).when(of == 5, F.concat(F.lit("HG"), n, F.lit("#x#chr2"))).otherwise(F.col("s_name"))
    return spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("path_id"), name.alias("name"))


def _refs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0,)], "path_id long")


def _chain_regions(spark: SparkSession, d: str) -> tuple:
    g = synth.chain(spark, d)
    called = written(calling.colour(g.tree, g.steps, _refs(spark)), "called")
    cols = written(calling.columns(called, g.links, g.comps), "columns")
    seen = written(calling.visits(cols, g.steps), "visits")
    return g, cols, seen


def _chain_records(spark: SparkSession, d: str) -> tuple:
    g = synth.chain(spark, d)
    return g, written(g.call(["H0"]), "records")


def _site(label: str = "id"):
    return F.regexp_extract(label, "^>([0-9]+)>", 1).cast("bigint")


def q_gfa_segments(spark, d):
    return gfa.segments(synth.chain(spark, d).lines())


def q_gfa_links(spark, d):
    return gfa.links(synth.chain(spark, d).lines())


def q_gfa_paths(spark, d):
    """Paths of odd numbers as W lines, the others as P lines."""
    lines = written(synth.chain(spark, d).lines(F.col("path_id") % 2 == 1), "lines")
    return gfa.steps(lines).join(gfa.paths(lines), "path_id").select("name", "step_idx", "seg_id", "strand")


#: Where the lines that _damaged() adds are numbered.
MORE_NO = 1 << 42


def _damaged(spark, d) -> DataFrame:
    """The chain's text with lines broken, added and said twice by their segments, links and paths."""
    lines = synth.chain(spark, d).lines()
    n = F.when(F.startswith("value", F.lit("S")), F.col("line_no") % 50).otherwise(-1)
    link = F.when(F.startswith("value", F.lit("L")), (F.col("line_no") - gfa.LINK_NO) % 50).otherwise(-1)
    path = F.when(F.startswith("value", F.lit("P")), (F.col("line_no") - gfa.PATH_NO) % 5).otherwise(-1)
    seg = F.element_at(F.split("value", "\t"), 2)
    broken = (
        F.when(n == 7, F.concat_ws("\t", F.lit("S"), seg, F.lit("*")))
        .when(link == 3, F.regexp_replace("value", "0M$", "5M"))
        .when(path == 2, F.regexp_replace("value", "\t\\*$", ""))
        .when(path == 3, F.regexp_replace("value", "[0-9]+\\+\t", "999999999+\t"))
        .otherwise(F.col("value"))
    )
    more = (
        F.when(n == 9, F.col("value"))
        .when(n == 11, F.concat(F.lit("Z\t"), seg))
        .when(n == 13, F.concat_ws("\t", F.lit("L"), seg, F.lit("+"), (seg.cast("bigint") + 1_000_000_000).cast("string"), F.lit("+"), F.lit("0M")))
    )
    added = lines.select((F.lit(MORE_NO) + F.col("line_no")).alias("line_no"), more.alias("value")).where("value IS NOT NULL")
    return lines.select("line_no", broken.alias("value")).unionByName(added)


def q_gfa_violations(spark, d):
    return gfa.violations(written(_damaged(spark, d), "lines")).select("rule", F.coalesce("line_no", F.lit(-1)).alias("line_no"), "detail")


def q_pansn_parts(spark, d):
    return graphs.path_names(_named(spark, d)).select("path_id", "name", "format", "sample", F.coalesce("hap_id", F.lit(-1)).alias("hap_id"), F.coalesce("contig", F.lit("-")).alias("contig"))


def q_ref_selection(spark, d):
    prefixes = spark.createDataFrame([("HG1",), ("ref",)], "prefix string")
    return graphs.select_references(_named(spark, d), prefixes).select("path_id", "name", "prefix")


def q_ploidy(spark, d):
    return graphs.ploidy(_named(spark, d))


def q_genotype_columns(spark, d):
    return graphs.genotype_columns(_named(spark, d))


def q_revcomp_segments(spark, d):
    s = synth.chain(spark, d).segments
    return s.select("seg_id", "seq", scalars.revcomp(F.col("seq")).alias("rc"))


def q_parse_walk(spark, d):
    steps = synth.chain(spark, d).steps
    w = steps.groupBy("path_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step_idx", "strand", "seg_id"))), lambda x: F.concat(x["strand"], x["seg_id"].cast("string"))), "").alias("w"))
    p = scalars.parse_walk(F.col("w"))
    ends = F.concat(F.lit("<"), F.get(p, F.lit(0))["seg_id"].cast("string"), F.lit("<"), F.element_at(p, -1)["seg_id"].cast("string"))
    return w.select("path_id", F.size(p).cast("bigint").alias("n"), scalars.walk_to_string(p).alias("back"), scalars.walk_to_string(scalars.flip_walk(p)).alias("flipped"), scalars.forwardise(ends).alias("forward"))


def q_step_loci(spark, d):
    g = synth.chain(spark, d)
    return graphs.with_loci(g.steps, g.segments).select("path_id", "step_idx", "seg_id", "locus")


def q_path_lengths(spark, d):
    g = synth.chain(spark, d)
    return graphs.path_lengths(g.steps, g.segments)


def q_bidirected_links(spark, d):
    return graphs.bidirected(synth.chain(spark, d).links).select("seg_id", "side", "other", "other_side")


def q_degree(spark, d):
    g = synth.orders(spark, d)
    return graphs.degrees(g.segments, g.links)


def q_tips(spark, d):
    g = synth.orders(spark, d)
    return graphs.tips(g.segments, g.links)


def _supplier_graph(spark, d) -> tuple:
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("seg_id"), F.col("s_nationkey").alias("n"), F.col("s_name").alias("seq"))
    w = Window.partitionBy("n").orderBy("seg_id")
    e = s.select(F.lag("seg_id").over(w).alias("v1"), F.lit("r").alias("v1_end"), F.col("seg_id").alias("v2"), F.lit("l").alias("v2_end")).where("v1 IS NOT NULL")
    return s.select("seg_id", "seq"), e.withColumn("edge_idx", F.col("v2"))


def q_components(spark, d):
    s, e = _supplier_graph(spark, d)
    return graphs.components(s, e)


def q_graph_info(spark, d):
    s, e = _supplier_graph(spark, d)
    return graphs.graph_info(s, e)


def q_laps(spark, d):
    g = synth.walks(spark, d)
    return graphs.laps(g.steps, spark.createDataFrame([(0,), (1,)], "seg_id long"))


def q_zip_positions(spark, d):
    return graphs.zip_positions(synth.walks(spark, d).steps, 0, 1)


def q_depth_walks(spark, d):
    cols = spark.createDataFrame([("all", c, c) for c in range(5)], "rov_id string, col long, seg_id long")
    return graphs.depth(synth.walks(spark, d).steps, cols).select("path_id", "col", "times", "code")


def q_unsupported_steps(spark, d):
    g = synth.walks(spark, d)
    return graphs.unsupported_steps(g.steps, g.links.where("edge_idx % 7 <> 3"))


def _event_stack(spark, d) -> DataFrame:
    g = synth.walks(spark, d)
    return g.steps.select(F.col("path_id").alias("comp_id"), F.col("step_idx").alias("i"), F.lit(">").alias("orient"), F.col("step_idx").alias("seg_id"), F.col("seg_id").alias("class_id"))


def q_class_next_seen(spark, d):
    return decompose.next_seen(_event_stack(spark, d)).select("comp_id", "i", "class_id", "nxt")


def q_stack_boundaries(spark, d):
    return decompose.boundaries(_event_stack(spark, d)).select("comp_id", "i", "j", "label")


def q_nesting(spark, d):
    b = decompose.boundaries(_event_stack(spark, d)).select("comp_id", "i", "j")
    return decompose.hierarchy(b).select("comp_id", "i", "j", F.coalesce(F.col("parent_hi") - F.col("parent_lo"), F.lit(-1)).alias("parent_size"), "level")


def q_class_stack(spark, d):
    g = synth.copies(spark, d, NESTED)
    first = F.min("tree_edge").over(Window.partitionBy("comp_id", "class_id"))
    return g.class_stack.select("comp_id", "i", "orient", "seg_id", "tree_edge", first.alias("group"))


def q_flubbles(spark, d):
    return synth.chain(spark, d).decompose().select("label", "height")


def q_families(spark, d):
    return synth.chain(spark, d).decompose(families=True).select("label", "sym")


def q_bracket_counts(spark, d):
    g = synth.chain(spark, d)
    return decompose.bracket_counts(g.links, g.comps).groupBy("comp_id").agg(F.count("*").alias("sides"), F.max("size").alias("size"), F.min("brackets").alias("least"))


def q_rov_columns(spark, d):
    _, cols, _ = _chain_regions(spark, d)
    return cols.select("label", "col", "seg_id")


def q_colour(spark, d):
    g = synth.chain(spark, d)
    return calling.colour(g.tree, g.steps, spark.createDataFrame([(0,), (3,)], "path_id long")).select("label")


def q_region(spark, d):
    g = synth.chain(spark, d)
    called = calling.colour(g.tree, g.steps, _refs(spark))
    return calling.restrict(called, g.loci, g.paths, "H0#1#chr1:20-160").select("label")


def q_depth_chain(spark, d):
    _, cols, seen = _chain_regions(spark, d)
    return seen.join(cols.select("rov_id", "col", "label", "seg_id"), ["rov_id", "col"]).select("label", "path_id", "seg_id", "code")


def q_contexts(spark, d):
    _, cols, seen = _chain_regions(spark, d)
    c = calling.contexts(calling.anchors(seen, _refs(spark)))
    seg = lambda k: cols.select("rov_id", F.col("col").alias(k), F.col("seg_id").alias("s" + k))
    return c.join(seg("u"), ["rov_id", "u"]).join(seg("v"), ["rov_id", "v"]).select("hap", "su", "sv")


def q_calls(spark, d):
    _, rec = _chain_records(spark, d)
    return rec.select("chrom", "pos", "id", "ref_seq", "alt", "vartype", "at", "es", "lv", F.col("ac").cast("bigint").alias("ac"), "an", "ns", F.col("af").cast("double").alias("af"))


def q_genotypes(spark, d):
    _, rec = _chain_records(spark, d)
    return calling.genotypes(rec, "id").select("id", "vartype", "hap_col", "allele")


def q_genotype_matrix(spark, d):
    g, rec = _chain_records(spark, d)
    return calling.with_genotypes(rec, g.paths).select("id", "vartype", F.array_join("gts", " ").alias("gts"))


def q_vcf_lines(spark, d):
    g, rec = _chain_records(spark, d)
    return calling.vcf_lines(rec, g.paths).select("line")


def q_nested_calls(spark, d):
    return synth.copies(spark, d, NESTED[:-1] + ["P\tHG3#1#chr1\t0+,2+,5+\t*"]).gfa2vcf(["HG1"], apart=True).select("line")


def q_collinear(spark, d):
    return collinear.collinear_sites(synth.chain(spark, d).steps, 0)


def q_collinear_calls(spark, d):
    return synth.chain(spark, d).call_collinear("H0").withColumn("ac", F.col("ac").cast("bigint"))


def q_vcf_validation(spark, d):
    g, rec = _chain_records(spark, d)
    text = calling.vcf_lines(rec, g.paths).select(F.monotonically_increasing_id().alias("line_no"), F.col("line").alias("value"))
    return g.validate(vcf.records(written(text, "lines")))[1]


def q_record_violations(spark, d):
    return validate.record_violations(vcf.records(synth.call_lines(spark, d, [*RAW, *BAD_RECORDS])))


def q_step_context(spark, d):
    return views.step_context(synth.chain(spark, d).steps, 9, 3)


def q_longest_loop(spark, d):
    return views.longest_loop(synth.walks(spark, d).steps)


def q_repeats(spark, d):
    return views.repeats(synth.walks(spark, d).steps, 12)


def q_subr(spark, d):
    return synth.copies(spark, d, HAIRPIN).inversions(["ref"], apart=True)


def q_pvst_lines(spark, d):
    return pvst.lines(synth.copies(spark, d, NESTED).tree).select("comp_id", "idx", "line")


def q_structure_json(spark, d):
    g, rec = _chain_records(spark, d)
    j = texts.structure_json(g.tree, rec)
    return j.select("kind", F.coalesce(F.get_json_object("json", "$.label"), F.get_json_object("json", "$.id")).alias("name"), F.coalesce(F.get_json_object("json", "$.af[0]"), F.lit("-")).alias("af"))


def _and_backwards(spark, d) -> DataFrame:
    """The chain's steps, and each path again backwards as path_id + 1000."""
    steps = written(synth.chain(spark, d).steps, "steps")
    n = steps.groupBy("path_id").agg(F.count("*").alias("n"))
    back = steps.join(n, "path_id").select((F.col("path_id") + 1000).alias("path_id"), (F.col("n") - 1 - F.col("step_idx")).alias("step_idx"), "seg_id", scalars.flip(F.col("strand")).alias("strand"))
    return steps.unionByName(back)


def q_reverse_paths(spark, d):
    return collinear.reverse_paths(_and_backwards(spark, d), 0)


def q_inverted_stretches(spark, d):
    steps = _and_backwards(spark, d)
    last = steps.where("path_id >= 1000").groupBy("path_id").agg(F.max("step_idx").alias("j"))
    zero = F.lit(0).cast("bigint")
    return inversions.stretches(last.select(zero.alias("ref"), F.col("path_id").alias("alt"), zero.alias("i"), "j"), steps)


def _claims(spark, d) -> DataFrame:
    c = synth.choices(spark, d)
    at = F.concat(F.lit(">"), (3 * F.col("s")).cast("string"), F.lit(">"), (3 * F.col("s") + 2).cast("string"))
    return c.select(F.concat_ws(":", "s", "h").alias("claim"), F.col("h").alias("path_id"), at.alias("at"))


def q_validate_calls(spark, d):
    return validate.check_calls(_claims(spark, d), synth.chain(spark, d).steps).select("claim", "found")


def q_validation_summary(spark, d):
    return validate.report(validate.check_calls(_claims(spark, d), synth.chain(spark, d).steps))


def q_vcf_genotypes(spark, d):
    """The chain's calls written as text and read back."""
    g, rec = _chain_records(spark, d)
    text = calling.vcf_lines(rec, g.paths).select(F.monotonically_increasing_id().alias("line_no"), F.col("line").alias("value"))
    back = vcf.records(written(text, "lines"))
    return vcf.genotype_entries(back).join(back.select("line_no", "id", vcf.info("VARTYPE").alias("vartype")), "line_no").select("id", "vartype", "sample_no", "phase", "allele")


def q_profile_top_level(spark, d):
    return profiles.top_level(vcf.records(synth.call_lines(spark, d, RAW))).select(vcf.line().alias("line"))


def q_profile_popped(spark, d):
    return profiles.popped(vcf.records(synth.call_lines(spark, d, RAW))).select(vcf.line().alias("line"))


def q_profile_left_normalised(spark, d):
    on_workers(spark)
    name = F.concat(F.lit("HG1#1#chr1_"), F.col("s_suppkey").cast("string"))
    fasta = spark.read.parquet(f"{d}/supplier.parquet").select(name.alias("name"), F.lit("AAAAAC").alias("sequence"))
    return profiles.left_normalised(vcf.records(synth.call_lines(spark, d, TANDEM)), fasta).select(vcf.line().alias("line"))


def q_profile_decomposed(spark, d):
    return profiles.decomposed(vcf.records(synth.call_lines(spark, d, COMPLEX))).select(vcf.line().alias("line"))


def q_prune(spark, d):
    g = synth.chain(spark, d)
    return g.prune().select("line")


def queries() -> dict:
    return {k[2:]: f for k, f in globals().items() if k.startswith("q_")} | structures.queries()



def _copied(lines: list[str]) -> str:
    """The call lines of every copy of a small graph."""
    told = lambda x: f"'{x[0]}' || ({synth.SEGMENTS_APART} * s_suppkey + {x[1:]})" if x[0] in "<>" and x[1:].isdigit() else "'_' || s_suppkey || chr(9)" if x == synth._CONTIG_END else "'" + x.replace("\t", "' || chr(9) || '") + "'"
    return " UNION ALL ".join("SELECT " + " || ".join(map(told, synth.pieces(line))) + " AS line FROM supplier" for line in lines)


SEQ = "substr(translate(md5(CAST({0} AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, CAST(1 + ({0}) % 4 AS INT))"
CHAIN = f"""
si AS (SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS s FROM supplier),
ch AS (SELECT s, CAST(n_nationkey AS BIGINT) AS h, CASE WHEN n_nationkey = 0 THEN 'R' ELSE CASE substr(md5(n_nationkey || ':' || s_suppkey), 1, 1)
       WHEN 'c' THEN 'A' WHEN 'd' THEN 'A' WHEN 'e' THEN 'D' WHEN 'f' THEN 'I' ELSE 'R' END END AS c FROM si, nation),
sg AS (SELECT h, 3 * s + unnest(CASE c WHEN 'R' THEN [0, 1] WHEN 'A' THEN [0, 2] WHEN 'D' THEN [0] ELSE [0, 1, 2] END) AS seg FROM ch
       UNION ALL SELECT h, 3 * max(s) + 3 FROM ch GROUP BY h),
st AS (SELECT h, CAST(row_number() OVER (PARTITION BY h ORDER BY seg) - 1 AS BIGINT) AS i, seg, {SEQ.format("seg")} AS q FROM sg),
lo AS (SELECT h, i, seg, q, CAST(1 + coalesce(sum(length(q)) OVER (PARTITION BY h ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS locus FROM st),
pr AS (SELECT DISTINCT seg AS a, lead(seg) OVER (PARTITION BY h ORDER BY i) AS b FROM st),
lk AS (SELECT a, b FROM pr WHERE b IS NOT NULL),
ct AS (SELECT s, count(*) FILTER (c = 'R') AS r, count(*) FILTER (c = 'A') AS a, count(*) FILTER (c = 'D') AS d, count(*) FILTER (c = 'I') AS i FROM ch GROUP BY s),
es AS (SELECT *, CASE WHEN a + d > 0 THEN 3 * s ELSE 3 * s + 1 END AS e FROM ct WHERE a + d + i > 0),
rl AS (SELECT seg, locus FROM lo WHERE h = 0),
cl AS (SELECT s, e, 'SUB' AS vartype, 'A' AS c, '>' || 3 * s || '>' || 3 * s + 3 AS id, a AS ac, r + a AS an FROM es WHERE a > 0
       UNION ALL SELECT s, e, 'DEL', 'D', '>' || 3 * s || '>' || 3 * s + 3, d, r + d FROM es WHERE d > 0
       UNION ALL SELECT s, e, 'INS', 'I', '>' || 3 * s + 1 || '>' || 3 * s + 3, i, r + i FROM es WHERE i > 0),
qs AS (SELECT s, {SEQ.format("3 * s")} AS qb, {SEQ.format("3 * s + 1")} AS qr, {SEQ.format("3 * s + 2")} AS qa FROM si),
ca AS (SELECT 'H0#1#chr1' AS chrom, CASE vartype WHEN 'INS' THEN n.locus - 1 WHEN 'DEL' THEN x.locus - 1 ELSE x.locus END AS pos, id,
       CASE vartype WHEN 'SUB' THEN qr WHEN 'DEL' THEN right(qb, 1) || qr ELSE right(qr, 1) END AS ref_seq,
       CASE vartype WHEN 'SUB' THEN qa WHEN 'DEL' THEN right(qb, 1) ELSE right(qr, 1) || qa END AS alt, vartype,
       CASE vartype WHEN 'SUB' THEN '>' || 3 * s + 1 || ',>' || 3 * s + 2 WHEN 'DEL' THEN '>' || 3 * s || '>' || 3 * s + 1 || ',>' || 3 * s
            ELSE '>' || 3 * s + 1 || ',>' || 3 * s + 1 || '>' || 3 * s + 2 END AS "at",
       '>' || e || '>' || 3 * s + 3 AS es, CAST(0 AS BIGINT) AS lv, ac, an, an AS ns, ac / an AS af, s, c
       FROM cl JOIN qs USING (s) JOIN rl x ON x.seg = 3 * s + 1 JOIN rl n ON n.seg = 3 * s + 3)
"""
WALKS = """
ty AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS seg FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)),
wk AS (SELECT user_id AS p, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i, seg FROM events JOIN ty USING (event_type) WHERE user_id IS NOT NULL),
nx AS (SELECT p, i, seg, coalesce(lead(i) OVER (PARTITION BY p, seg ORDER BY i), i) AS n FROM wk),
bd AS (SELECT p, i, n AS j FROM nx WHERE n > i + 1)
"""
ORDERS = """
ls AS (SELECT l_orderkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS i, l_partkey AS seg FROM lineitem),
ol AS (SELECT DISTINCT a, b FROM (SELECT seg AS a, lead(seg) OVER (PARTITION BY p ORDER BY i) AS b FROM ls) WHERE b IS NOT NULL),
dg AS (SELECT seg, (SELECT count(*) FROM ol WHERE b = seg) AS deg_l, (SELECT count(*) FROM ol WHERE a = seg) AS deg_r FROM (SELECT DISTINCT seg FROM ls))
"""
NAMED = """(SELECT s_suppkey AS path_id, CASE WHEN s_suppkey % 7 < 4 THEN 'HG' || s_nationkey || '#' || s_suppkey % 3 || '#chr' || s_suppkey % 5 WHEN s_suppkey % 7 = 4 THEN 'ref' || s_suppkey
    WHEN s_suppkey % 7 = 5 THEN 'HG' || s_nationkey || '#x#chr2' ELSE s_name END AS name FROM supplier)"""
PARTS = f"pn AS (SELECT path_id, name, regexp_full_match(name, '[^#]*#[0-9]+#[^#]*') AS ok FROM {NAMED}), pp AS (SELECT path_id, name, CASE WHEN ok THEN 'PANSN' ELSE 'RAW' END AS format, CASE WHEN ok THEN split_part(name, '#', 1) ELSE name END AS sample, CASE WHEN ok THEN CAST(split_part(name, '#', 2) AS BIGINT) END AS hap_id, CASE WHEN ok THEN split_part(name, '#', 3) END AS contig FROM pn)"

COPIES = "(SELECT s_suppkey AS k, row_number() OVER (ORDER BY s_suppkey) AS c FROM supplier)"


def oracle_sql() -> dict[str, str]:
    return {
        "gfa_segments": f"WITH {CHAIN} SELECT DISTINCT seg AS seg_id, q AS seq FROM st",
        "gfa_links": f"WITH {CHAIN} SELECT row_number() OVER (ORDER BY a, b) - 1 AS edge_idx, a AS v1, 'r' AS v1_end, b AS v2, 'l' AS v2_end FROM lk",
        "gfa_paths": f"WITH {CHAIN}, n AS (SELECT h, 'H' || h || '#1#chr1' || CASE WHEN h % 2 = 1 THEN ':0-' || CAST(sum(length(q)) AS BIGINT) ELSE '' END AS name FROM st GROUP BY h) SELECT name, i AS step_idx, seg AS seg_id, '>' AS strand FROM st JOIN n USING (h)",
        "gfa_violations": f"""WITH {CHAIN}, s AS (SELECT DISTINCT seg FROM st), e AS (SELECT row_number() OVER (ORDER BY a, b) - 1 AS k FROM lk), z AS (SELECT h, max(i) AS i FROM st GROUP BY h)
            SELECT 'segment' AS rule, seg AS line_no, CAST(seg AS VARCHAR) AS detail FROM s WHERE seg % 50 = 7
            UNION ALL SELECT 'duplicate', {MORE_NO} + seg, CAST(seg AS VARCHAR) FROM s WHERE seg % 50 = 9
            UNION ALL SELECT 'kind', {MORE_NO} + seg, 'Z' FROM s WHERE seg % 50 = 11
            UNION ALL SELECT 'dangling_link', {MORE_NO} + seg, CAST(seg + 1000000000 AS VARCHAR) FROM s WHERE seg % 50 = 13
            UNION ALL SELECT 'overlap', {gfa.LINK_NO} + k, '5M' FROM e WHERE k % 50 = 3
            UNION ALL SELECT 'path', {gfa.PATH_NO} + h, 'H' || h || '#1#chr1' FROM z WHERE h % 5 = 2
            UNION ALL SELECT 'dangling_step', {gfa.PATH_NO} + h, '999999999' FROM z WHERE h % 5 = 3
            UNION ALL SELECT 'unsupported_step', {gfa.PATH_NO} + h, CAST(i - 1 AS VARCHAR) FROM z WHERE h % 5 = 3""",
        "pansn_parts": f"WITH {PARTS} SELECT path_id, name, format, sample, coalesce(hap_id, -1) AS hap_id, coalesce(contig, '-') AS contig FROM pp",
        "ref_selection": f"WITH {PARTS} SELECT path_id, name, prefix FROM pp, (VALUES ('HG1'), ('ref')) AS x(prefix) WHERE (format = 'PANSN' AND sample = prefix) OR (format = 'RAW' AND starts_with(sample, prefix)) OR starts_with(name, prefix)",
        "ploidy": f"WITH {PARTS} SELECT sample, string_agg(h, ',' ORDER BY h) AS haps, count(*) AS ploidy FROM (SELECT DISTINCT sample, hap_id AS h FROM pp WHERE format = 'PANSN') GROUP BY sample",
        "genotype_columns": f"WITH {PARTS}, c AS (SELECT sample, row_number() OVER (ORDER BY min(path_id)) - 1 AS hap_col FROM pp GROUP BY sample) SELECT CAST(path_id AS BIGINT) AS path_id, sample, CAST(hap_col AS BIGINT) AS hap_col, CAST(dense_rank() OVER (PARTITION BY sample ORDER BY hap_id) - 1 AS BIGINT) AS phase FROM pp JOIN c USING (sample)",
        "revcomp_segments": f"WITH {CHAIN} SELECT DISTINCT seg AS seg_id, q AS seq, reverse(translate(q, 'ACGT', 'TGCA')) AS rc FROM st",
        "parse_walk": f"""WITH {CHAIN} SELECT h AS path_id, count(*) AS n, string_agg('>' || seg, '' ORDER BY i) AS back, string_agg('<' || seg, '' ORDER BY i DESC) AS flipped, '>' || arg_max(seg, i) || '>' || arg_min(seg, i) AS forward FROM st GROUP BY h""",
        "step_loci": f"WITH {CHAIN} SELECT h AS path_id, i AS step_idx, seg AS seg_id, locus FROM lo",
        "path_lengths": f"WITH {CHAIN} SELECT h AS path_id, count(*) AS n_steps, CAST(sum(length(q)) AS BIGINT) AS hap_len FROM st GROUP BY h",
        "bidirected_links": f"WITH {CHAIN} SELECT a AS seg_id, 'r' AS side, b AS other, 'l' AS other_side FROM lk UNION ALL SELECT b, 'l', a, 'r' FROM lk",
        "degree": f"WITH {ORDERS} SELECT seg AS seg_id, deg_l, deg_r FROM dg",
        "tips": f"WITH {ORDERS} SELECT seg AS seg_id, 'l' AS side FROM dg WHERE deg_l = 0 UNION ALL SELECT seg, 'r' FROM dg WHERE deg_r = 0 AND deg_l > 0",
        "components": "SELECT s_suppkey AS seg_id, root, dense_rank() OVER (ORDER BY root) AS comp_id FROM (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS root FROM supplier)",
        "graph_info": "SELECT row_number() OVER (ORDER BY m) AS comp_id, n AS vertices, n - 1 AS edges, CASE WHEN n = 1 THEN 1 ELSE 2 END::BIGINT AS tips FROM (SELECT min(s_suppkey) AS m, count(*) AS n FROM supplier GROUP BY s_nationkey)",
        "laps": f"WITH {WALKS}, x AS (SELECT p, i, i - row_number() OVER (PARTITION BY p ORDER BY i) AS g FROM wk WHERE seg < 2) SELECT p AS path_id, row_number() OVER (PARTITION BY p ORDER BY min(i)) - 1 AS lap_no, min(i) AS first_step, count(*) AS n FROM x GROUP BY p, g",
        "zip_positions": f"WITH {WALKS}, r AS (SELECT p, i, seg, row_number() OVER (PARTITION BY p, seg ORDER BY i) AS rn FROM wk WHERE seg < 2) SELECT a.p AS path_id, a.rn AS rn, least(a.i, b.i) AS lo, greatest(a.i, b.i) AS hi FROM r a JOIN r b ON a.p = b.p AND a.rn = b.rn AND a.seg = 0 AND b.seg = 1",
        "depth_walks": f"WITH {WALKS} SELECT p AS path_id, seg AS col, count(*) AS times, count(*) AS code FROM wk GROUP BY p, seg",
        "unsupported_steps": f"WITH {WALKS}, s AS (SELECT p, i, seg AS a, lead(seg) OVER (PARTITION BY p ORDER BY i) AS b FROM wk), l AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS k FROM (SELECT DISTINCT a, b FROM s WHERE b IS NOT NULL)) SELECT p AS path_id, i AS step_idx FROM s JOIN l USING (a, b) WHERE k % 7 = 3",
        "class_next_seen": f"WITH {WALKS} SELECT p AS comp_id, i, seg AS class_id, n AS nxt FROM nx",
        "stack_boundaries": f"WITH {WALKS} SELECT p AS comp_id, i, j, '>' || i || '>' || j AS label FROM bd",
        "nesting": f"WITH {WALKS} SELECT x.p AS comp_id, x.i AS i, x.j AS j, coalesce(min(y.j - y.i), -1) AS parent_size, count(y.i) AS level FROM bd x LEFT JOIN bd y ON x.p = y.p AND y.i <= x.i AND x.j <= y.j AND (y.i < x.i OR x.j < y.j) GROUP BY ALL",
        "class_stack": f"SELECT c AS comp_id, CAST(i AS BIGINT) AS i, o AS orient, {synth.SEGMENTS_APART} * k + s AS seg_id, CAST(e AS BIGINT) AS tree_edge, CAST(g AS BIGINT) AS \"group\" FROM {COPIES}, (VALUES (0, '>', 0, 1, 1), (1, '>', 1, 3, 3), (2, '>', 3, 5, 5), (3, '>', 4, 7, 3), (4, '<', 2, 12, 12), (5, '>', 5, 9, 1)) AS t(i, o, s, e, g)",
        "flubbles": f"WITH {CHAIN} SELECT '>' || e || '>' || 3 * s + 3 AS label, CAST(1 AS BIGINT) AS height FROM es",
        "families": f"WITH {CHAIN} SELECT '>' || e || '>' || 3 * s + 3 AS label, CASE WHEN i > 0 AND a + d > 0 THEN 'O' ELSE 'T' END AS sym FROM es",
        "bracket_counts": f"WITH {CHAIN} SELECT CAST(1 AS BIGINT) AS comp_id, 2 * count(DISTINCT seg) AS sides, 2 * count(DISTINCT seg) AS size, CAST(0 AS BIGINT) AS least FROM st",
        "rov_columns": f"WITH {CHAIN}, x AS (SELECT s, e, '>' || e || '>' || 3 * s + 3 AS label, 3 * s + unnest(CASE WHEN a + i > 0 THEN [0, 1, 2, 3] ELSE [0, 1, 3] END) AS seg_id FROM es) SELECT label, row_number() OVER (PARTITION BY label ORDER BY seg_id) - 1 AS col, seg_id FROM x WHERE seg_id >= e",
        "colour": f"WITH {CHAIN} SELECT '>' || e || '>' || 3 * s + 3 AS label FROM es WHERE e IN (SELECT seg FROM st WHERE h = 3)",
        "region": f"WITH {CHAIN} SELECT DISTINCT '>' || e || '>' || 3 * s + 3 AS label FROM es JOIN rl ON seg IN (e, 3 * s + 3) WHERE locus >= 20 AND locus < 160",
        "depth_chain": f"WITH {CHAIN} SELECT '>' || e || '>' || 3 * s + 3 AS label, h AS path_id, seg AS seg_id, CAST(1 AS BIGINT) AS code FROM es JOIN st ON seg BETWEEN e AND 3 * s + 3",
        "contexts": f"WITH {CHAIN} SELECT h AS hap, CASE c WHEN 'I' THEN 3 * s + 1 ELSE 3 * s END AS su, 3 * s + 3 AS sv FROM ch WHERE c <> 'R'",
        "calls": f"WITH {CHAIN} SELECT chrom, pos, id, ref_seq, alt, vartype, \"at\", es, lv, ac, an, ns, af FROM ca",
        "genotypes": f"WITH {CHAIN} SELECT id, vartype, h AS hap_col, CAST(CASE ch.c WHEN 'R' THEN 0 ELSE 1 END AS BIGINT) AS allele FROM ca JOIN ch ON ch.s = ca.s AND ch.c IN ('R', ca.c)",
        "genotype_matrix": f"WITH {CHAIN} SELECT id, vartype, string_agg(CASE ch.c WHEN 'R' THEN '0' WHEN ca.c THEN '1' ELSE '.' END, ' ' ORDER BY h) AS gts FROM ca JOIN ch ON ch.s = ca.s GROUP BY id, vartype",
        "vcf_lines": f"""WITH {CHAIN} SELECT concat_ws(chr(9), chrom, pos, id, ref_seq, alt, '60', 'PASS', 'AC=' || ac || ';AF=' || CAST(any_value(af) AS VARCHAR) || ';AN=' || an || ';NS=' || ns || ';AT=' || "at" || ';VARTYPE=' || vartype || ';TANGLED=F;ES=' || es || ';LV=0', 'GT',
            string_agg(CASE ch.c WHEN 'R' THEN '0' WHEN ca.c THEN '1' ELSE '.' END, chr(9) ORDER BY h)) AS line FROM ca JOIN ch ON ch.s = ca.s GROUP BY chrom, pos, id, ref_seq, alt, ac, an, ns, "at", vartype, es""",
        "nested_calls": _copied(["HG1#1#chr1\t2\t>1>4\tCT\tC\t60\tPASS\tAC=1;AF=0.5;AN=2;NS=2;AT=>1>3,>1;VARTYPE=DEL;TANGLED=F;ES=>1>4;LV=1\tGT\t0\t1\t."]),
        "collinear": f"""WITH {CHAIN} SELECT h AS path_id, CASE c WHEN 'I' THEN 2 * s + 1 ELSE 2 * s END AS ref_start, 2 * s + 2 AS ref_end, CASE c WHEN 'I' THEN '' ELSE '>' || 3 * s + 1 END AS ref_walk,
            CASE c WHEN 'D' THEN '' ELSE '>' || 3 * s + 2 END AS alt_walk FROM ch JOIN ct USING (s) WHERE c = 'I' OR (c IN ('A', 'D') AND i = 0)""",
        "collinear_calls": f"WITH {CHAIN} SELECT chrom, pos, id, ref_seq, alt, vartype, ac, an FROM ca JOIN ct USING (s) WHERE ca.c = 'I' OR ct.i = 0",
        "vcf_validation": f"WITH {CHAIN} SELECT CAST(sum(an) AS BIGINT) AS claims, CAST(0 AS BIGINT) AS bad, CAST(0 AS DOUBLE) AS error_rate FROM ca",
        "record_violations": f"SELECT {synth.SEGMENTS_APART} * s_suppkey + n AS line_no, rule FROM supplier, (VALUES (2, 'place'), (2, 'allele'), (2, 'number'), (2, 'counts'), (3, 'repeated'), (4, 'kind')) AS t(n, rule)",
        "step_context": f"WITH {CHAIN} SELECT h AS path_id, i AS step_idx, (SELECT string_agg('>' || x.seg, '' ORDER BY x.i) FROM st x WHERE x.h = st.h AND x.i BETWEEN st.i - 3 AND st.i + 3) AS context FROM st WHERE seg = 9",
        "longest_loop": f"WITH {WALKS} SELECT p AS path_id, seg AS seg_id, n AS times FROM (SELECT p, seg, count(*) AS n, row_number() OVER (PARTITION BY p ORDER BY count(*) DESC, seg) AS k FROM wk GROUP BY p, seg) WHERE k = 1",
        "repeats": f"WITH {WALKS} SELECT p AS path_id, seg AS seg_id, count(*) AS times, min(i) AS first_step, max(i) AS last_step FROM wk GROUP BY p, seg HAVING count(*) >= 12",
        "subr": f"""SELECT 'ref_' || k AS chrom, CAST(2 AS BIGINT) AS pos, '>' || x + 1 || '>' || x + 5 AS id, 'ACGTA' AS ref_seq, 'TACGT' AS alt, '1' AS ac, CAST(2 AS BIGINT) AS an, CAST(2 AS BIGINT) AS ns,
            '>' || x + 1 || '>' || x + 2 || '>' || x + 3 || '>' || x + 4 || '>' || x + 5 || ',<' || x + 5 || '<' || x + 4 || '<' || x + 3 || '<' || x + 2 || '<' || x + 1 AS "at", CAST(2 * c - 1 AS VARCHAR) AS hap_cols FROM (SELECT *, {synth.SEGMENTS_APART} * k AS x FROM {COPIES})""",
        "pvst_lines": f"""SELECT c AS comp_id, CAST(n AS BIGINT) AS idx, concat_ws(chr(9), sym, a, b, kids, route) AS line FROM (SELECT *, {synth.SEGMENTS_APART} * k AS x FROM {COPIES}),
            LATERAL (VALUES (-1, 'H', '0.0.3', '.', '.', '.'), (0, 'D', '0', '.', '1', '.'), (1, 'F', '1', '>' || x || '>' || x + 5, '2', 'L'), (2, 'F', '2', '>' || x + 1 || '>' || x + 4, '.', 'L')) AS t(n, sym, a, b, kids, route)""",
        "structure_json": f"WITH {CHAIN} SELECT 'pvst_node' AS kind, '>' || e || '>' || 3 * s + 3 AS name, '-' AS af FROM es UNION ALL SELECT 'pvst_node', '.', '-' UNION ALL SELECT 'variant_call', id, ac || '/' || an FROM ca",
        "reverse_paths": f"WITH {CHAIN}, w AS (SELECT h, list(seg ORDER BY i) AS w FROM st GROUP BY h) SELECT CAST(a.h + 1000 AS BIGINT) AS path_id FROM w a JOIN w b ON a.w = b.w AND b.h = 0",
        "inverted_stretches": f"""WITH {CHAIN}, n AS (SELECT h, count(*) AS n FROM st GROUP BY h), z AS (SELECT i, seg FROM st WHERE h = 0),
            p AS (SELECT n.h AS h, n, coalesce(min(st.i), n) AS len FROM n LEFT JOIN (SELECT st.h, st.i FROM st LEFT JOIN z ON st.i = z.i AND st.seg = z.seg WHERE z.i IS NULL) st ON n.h = st.h GROUP BY n.h, n)
            SELECT CAST(0 AS BIGINT) AS ref, CAST(h + 1000 AS BIGINT) AS alt, CAST(0 AS BIGINT) AS ref_start, CAST(n - len AS BIGINT) AS alt_start, CAST(len AS BIGINT) AS len FROM p WHERE len > 1""",
        "validate_calls": f"WITH {CHAIN} SELECT s || ':' || h AS claim, c = 'A' AS found FROM ch",
        "validation_summary": f"WITH {CHAIN} SELECT count(*) AS claims, count(*) FILTER (c <> 'A') AS bad, 100.0::DOUBLE * count(*) FILTER (c <> 'A') / count(*) AS error_rate FROM ch",
        "vcf_genotypes": f"WITH {CHAIN} SELECT id, vartype, h AS sample_no, CAST(0 AS BIGINT) AS phase, CAST(CASE ch.c WHEN 'R' THEN 0 ELSE 1 END AS BIGINT) AS allele FROM ca JOIN ch ON ch.s = ca.s AND ch.c IN ('R', ca.c)",
        "profile_top_level": _copied(TOP_LINES),
        "profile_popped": _copied(POPPED_LINES),
        "profile_left_normalised": _copied(NORM_LINES),
        "profile_decomposed": _copied(DECOMPOSED_LINES),
        "prune": f"WITH {CHAIN} SELECT concat_ws(chr(9), 'S', seg, 'A') AS line FROM (SELECT DISTINCT seg FROM st) UNION ALL SELECT concat_ws(chr(9), 'L', a, '+', b, '+', '0M') FROM lk",
        **structures.oracle_sql(),
    }
