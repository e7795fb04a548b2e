"""FASTA, lists of references, and text forms of graphs and trees (DOT, GML, JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pvst


def fasta(lines: DataFrame) -> DataFrame:
    """(name, sequence) of lines(line_no, value): the first word of each header and the letters up to the next.

    Headers' places are found by a running maximum within blocks of a million lines and their last headers before them.
    """
    x = lines.where("value <> ''").withColumn("_b", F.floor(F.col("line_no") / 1_000_000))
    x = x.withColumn("_h", F.when(F.startswith("value", F.lit(">")), F.col("line_no")))
    last = x.groupBy("_b").agg(F.max("_h").alias("_l"))
    last = last.select("_b", F.max("_l").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.max("_h").over(Window.partitionBy("_b").orderBy("line_no"))
    x = x.join(last, "_b").withColumn("_at", F.coalesce(own, F.col("_before")))
    names = x.where("_h IS NOT NULL").select(F.col("_h").alias("_at"), F.get(F.split(F.expr("substr(value, 2)"), "\\s"), F.lit(0)).alias("name"))
    body = x.where("_h IS NULL").groupBy("_at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.trim("value").alias("v")))), lambda r: r["v"]), "").alias("sequence"))
    return names.join(body, "_at", "left").select("name", F.coalesce("sequence", F.lit("")).alias("sequence"))


def reference_list(spark: SparkSession, path: str) -> DataFrame:
    """(prefix): the first word of each line that is neither blank nor a comment."""
    return spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND NOT v LIKE '#%'").select(F.get(F.split("v", "\\s+"), F.lit(0)).alias("prefix"))


def search(lines: DataFrame, text: str) -> DataFrame:
    """Lines that hold the text."""
    return lines.where(F.contains("value", F.lit(text)))


def dot_graph(segments: DataFrame, links: DataFrame) -> DataFrame:
    """(line) of a DOT graph's body, a node per segment and an edge per link with its sides."""
    n = segments.select(F.format_string('%d [label="%d"];', "seg_id", "seg_id").alias("line"))
    return n.unionByName(links.select(F.format_string('%d -- %d [taillabel="%s", headlabel="%s"];', "v1", "v2", "v1_end", "v2_end").alias("line")))


def dot_tree(tree: DataFrame) -> DataFrame:
    """(comp_id, line) of a bubble tree in DOT."""
    n = pvst.nodes(tree)
    return n.select("comp_id", F.format_string('%d [label="%s"];', "idx", "label").alias("line")).unionByName(n.where("parent_idx IS NOT NULL").select("comp_id", F.format_string("%d -> %d;", "parent_idx", "idx").alias("line")))


def gml_tree(tree: DataFrame) -> DataFrame:
    """(comp_id, line) of a bubble tree in GML."""
    n = pvst.nodes(tree)
    return n.select("comp_id", F.format_string('node [ id %d label "%s" ]', "idx", "label").alias("line")).unionByName(n.where("parent_idx IS NOT NULL").select("comp_id", F.format_string("edge [ source %d target %d ]", "parent_idx", "idx").alias("line")))


def _json(df: DataFrame, kind: str, n: str, *fields) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col(n).cast("bigint").alias("n"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def stack_entries(stack: DataFrame) -> DataFrame:
    """(kind, n, json): an entry of the class stack with the next place of its class and whether that opens a bubble.

    stack: next_seen() of a class stack. An entry of a class that never comes again points at itself.
    """
    return _json(stack, "stack_entry", "i", F.col("comp_id").alias("component"), F.col("i").alias("order"), F.col("tree_edge").alias("tree_edge_index"), F.col("seg_id").alias("boundary_vertex_id"), F.col("orient").alias("orientation"), "class_id", F.col("nxt").alias("next_seen"), (F.col("nxt") > F.col("i") + 1).alias("opens"))


def structure_export(segments: DataFrame, links: DataFrame, paths: DataFrame, steps: DataFrame, nodes: DataFrame, stack: DataFrame, records: DataFrame, matrix: DataFrame) -> DataFrame:
    """(kind, n, json): everything that calling knows, a line per row.

    Kinds: segment, link, path (with its walk), boundary_candidate and pvst_node (of nodes: the bubble tree with its roots),
    stack_entry (of next_seen() stacks) and variant_call (records with their genotype matrix). n orders the lines of a
    kind, of a component where they have one. Allele frequencies are exact ratios.
    """
    sign = lambda side, plus: F.when(F.col(side) == plus, "+").otherwise("-")
    walk = F.transform(F.sort_array(F.collect_list(F.struct("step_idx", F.concat("strand", F.col("seg_id").cast("string")).alias("t")))), lambda x: x["t"])
    walks = paths.join(steps.groupBy("path_id").agg(walk.alias("steps")), "path_id", "left")
    family = F.create_map(*[F.lit(x) for pair in pvst.FAMILIES.items() for x in pair])[F.col("sym")]
    node_id = lambda i: F.concat_ws(":", F.col("comp_id").cast("string"), F.col(i).cast("string"))
    ends = F.regexp_extract_all("label", F.lit("([<>][0-9]+)"), F.lit(1))
    held = nodes.where("parent_idx IS NOT NULL").groupBy("comp_id", F.col("parent_idx").alias("idx")).agg(F.sort_array(F.collect_list("idx")).alias("kids"))
    n = nodes.join(held, ["comp_id", "idx"], "left").withColumn("kids", F.coalesce("kids", F.array().cast("array<bigint>")))
    n = n.withColumn("start", F.get(ends, F.lit(0))).withColumn("end", F.get(ends, F.lit(1))).withColumn("way", F.when(F.col("route") == "L", "s2e").when(F.col("route") == "R", "e2s"))
    route = n.where("sym <> 'D'")
    r = records.join(matrix, ["rov_id", "ref", "u", "v", "vartype"])
    alts = F.transform(F.arrays_zip(F.split("alt", ",").alias("dna"), F.slice(F.split("at", ","), 2, 1 << 20).alias("walk"), F.split("ac", ",").alias("ac")), lambda x, i: F.struct((i + 1).alias("index"), x["dna"].alias("dna"), x["walk"].alias("traversal"), x["ac"].cast("bigint").alias("count")))
    ratio = F.transform(F.split("ac", ","), lambda a: F.concat(a, F.lit("/"), F.col("an").cast("string")))
    out = [
        _json(segments, "segment", "seg_id", F.col("seg_id").alias("id"), F.col("seq").alias("sequence")),
        _json(links, "link", "edge_idx", F.col("edge_idx").alias("order"), F.col("v1").alias("from"), sign("v1_end", "r").alias("from_orient"), F.col("v2").alias("to"), sign("v2_end", "l").alias("to_orient"), F.lit("0M").alias("overlap")),
        _json(walks, "path", "path_id", F.col("path_id").alias("order"), "name", "steps"),
        _json(route, "boundary_candidate", "idx", node_id("idx").alias("node_id"), family.alias("family"), "start", "end", F.col("way").alias("route"), F.concat("start", "end").alias("boundary")),
        _json(n, "pvst_node", "idx", node_id("idx").alias("node_id"), F.col("comp_id").alias("component"), family.alias("family"), "label", "start", "end", F.col("way").alias("route"), F.when(F.col("parent_idx").isNotNull(), node_id("parent_idx")).alias("parent"), F.transform("kids", lambda k: F.concat_ws(":", F.col("comp_id").cast("string"), k.cast("string"))).alias("children")),
        stack_entries(stack),
        _json(r, "variant_call", "pos", F.struct(F.lit("flubble").alias("kind"), F.col("es").alias("enclosing_site"), F.col("lv").alias("level")).alias("source"), "chrom", "pos", "id", F.col("ref_seq").alias("ref"), F.get(F.split("at", ","), F.lit(0)).alias("ref_traversal"), alts.alias("alternates"), F.col("vartype").alias("variant_type"), (F.col("tangled") == "T").alias("tangled"), ratio.alias("af"), "an", "ns", F.col("gts").alias("genotypes")),
    ]
    result = out[0]
    for x in out[1:]:
        result = result.unionByName(x)
    return result


def structure_json(tree: DataFrame, records: DataFrame) -> DataFrame:
    """(kind, json): a line per tree node and per call; allele frequencies as exact ratios."""
    n = pvst.nodes(tree).select(F.lit("pvst_node").alias("kind"), F.to_json(F.struct("comp_id", "idx", "sym", "label", "parent_idx", "height")).alias("json"))
    ratio = F.transform(F.split("ac", ","), lambda a: F.concat(a, F.lit("/"), F.col("an").cast("string"))).alias("af")
    c = records.select(F.lit("variant_call").alias("kind"), F.to_json(F.struct("chrom", "pos", "id", F.col("ref_seq").alias("ref"), F.split("alt", ",").alias("alt"), "vartype", F.split("at", ",").alias("at"), "es", "lv", F.split("ac", ",").cast("array<bigint>").alias("ac"), "an", "ns", ratio)).alias("json"))
    return n.unionByName(c)
