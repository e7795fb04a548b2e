"""Bubble trees as text: a row per node with symbol, number, label, children and route."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.durable import written

VERSION = "0.0.3"
#: Symbols of node families. Fixed values.
FAMILIES = {"H": "header", "D": "dummy", "F": "flubble", "T": "tiny", "O": "parallel", "C": "concealed", "S": "smothered", "M": "midi"}


class InvalidTree(ValueError):
    """The text is no tree of this version."""


def nodes(tree: DataFrame) -> DataFrame:
    """(comp_id, idx, sym, label, parent_idx, height): bubbles numbered from 1 by their start, under a root numbered 0.

    sym is the tree's own where it has families, else F.
    """
    sym = F.col("sym") if "sym" in tree.columns else F.lit("F").alias("sym")
    n = tree.withColumn("idx", F.row_number().over(Window.partitionBy("comp_id").orderBy("i", F.desc("j"))).cast("bigint"))
    up = n.select("comp_id", F.col("i").alias("parent_lo"), F.col("j").alias("parent_hi"), F.col("idx").alias("up"))
    own = n.join(up, ["comp_id", "parent_lo", "parent_hi"], "left").select("comp_id", "idx", sym, "label", F.coalesce("up", F.lit(0).cast("bigint")).alias("parent_idx"), F.col("height").cast("bigint").alias("height"))
    return with_root(written(own, "nodes"))


def with_root(bubbles: DataFrame) -> DataFrame:
    """bubbles(comp_id, idx, sym, label, parent_idx, ...) and each component's root, numbered 0."""
    told = {"idx": F.lit(0).cast("bigint"), "sym": F.lit("D"), "label": F.lit("."), "height": F.lit(0).cast("bigint"), "route": F.lit(".")}
    root = bubbles.select("comp_id").distinct().select("comp_id", *[told.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in bubbles.schema if f.name != "comp_id"])
    return root.unionByName(bubbles)


def lines_of(n: DataFrame) -> DataFrame:
    """(comp_id, idx, line) of nodes under their roots, the header at idx -1; children apart by comma and space, a full stop for none."""
    route = F.col("route") if "route" in n.columns else F.when(F.col("sym") == "D", ".").otherwise("L")
    kids = n.where("parent_idx IS NOT NULL").groupBy("comp_id", F.col("parent_idx").alias("idx")).agg(F.array_join(F.sort_array(F.collect_list("idx")).cast("array<string>"), ", ").alias("kids"))
    body = n.join(kids, ["comp_id", "idx"], "left").select("comp_id", "idx", F.concat_ws("\t", "sym", F.col("idx").cast("string"), "label", F.coalesce("kids", F.lit(".")), route).alias("line"))
    head = n.select("comp_id").distinct().select("comp_id", F.lit(-1).cast("bigint").alias("idx"), F.lit(f"H\t{VERSION}\t.\t.\t.").alias("line"))
    return head.unionByName(body)


def lines(tree: DataFrame) -> DataFrame:
    """lines_of() the plain bubbles of a tree."""
    return lines_of(nodes(tree))


def write(tree: DataFrame, path: str) -> None:
    """A folder per component below path."""
    lines(tree).repartition("comp_id").sortWithinPartitions("comp_id", "idx").select("comp_id", F.col("line").alias("value")).write.partitionBy("comp_id").text(path)


def parse(rows: DataFrame) -> DataFrame:
    """(file, idx, sym, label, parent_idx, route) from rows(file, value). Raises InvalidTree on other versions, symbols or widths."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    r = rows.where("value <> ''").select("file", at(0).alias("sym"), at(1).alias("a"), at(2).alias("label"), at(3).alias("kids"), at(4).alias("route"), F.size(f).alias("n"))
    bad = r.where((F.col("n") != 5) | ~F.col("sym").isin(*FAMILIES) | ((F.col("sym") == "H") & (F.col("a") != VERSION))).take(1)
    if bad:
        raise InvalidTree(f"not a bubble tree of version {VERSION}: {bad[0].asDict()}")
    body = r.where("sym <> 'H'").withColumn("idx", F.col("a").cast("bigint"))
    kids = body.where("kids <> '.'").select("file", F.col("idx").alias("parent_idx"), F.explode(F.split("kids", ",")).alias("k")).select("file", "parent_idx", F.trim("k").cast("bigint").alias("idx"))
    return body.join(kids, ["file", "idx"], "left").select("file", "idx", "sym", "label", "parent_idx", "route")


def read(spark: SparkSession, path: str) -> DataFrame:
    """parse() of every file below path. Raises InvalidTree if there is none."""
    rows = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    if not rows.take(1):
        raise InvalidTree(f"no bubble tree below {path}")
    return parse(rows)
