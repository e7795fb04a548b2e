"""Graphs derived from relational tables: the chain of allele sites, user walks, order walks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import gfa
from .durable import numbered, written
from .graph_api import Graph


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, h, c): haplotype h's allele at site s: R, A (substituted), D (deleted), I (inserted). Haplotype 0 has R.

    Sites are suppliers by rank, haplotypes nations; the allele follows from a digest of both keys.
    """
    sites = numbered(_table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", name="s")
    haps = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("h"))
    digit = F.substring(F.md5(F.concat_ws(":", F.col("h").cast("string"), F.col("s_suppkey").cast("string")).cast("binary")), 1, 1)
    allele = F.when(F.col("h") == 0, "R").when(digit.isin("c", "d"), "A").when(digit == "e", "D").when(digit == "f", "I").otherwise("R")
    return sites.join(F.broadcast(haps)).select("s", "h", allele.alias("c"))


def sequence_of(seg_id: str) -> Column:
    """The invented sequence of a segment: 1 to 4 bases of its digest."""
    return F.expr(f"substr(translate(md5(CAST(CAST({seg_id} AS STRING) AS BINARY)), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, CAST(1 + {seg_id} % 4 AS INT))")


def chain(spark: SparkSession, sf_dir: str) -> Graph:
    """Backbone 3s, reference allele 3s + 1 and other allele 3s + 2 per site s, and a last backbone segment."""
    c = choices(spark, sf_dir)
    ids = F.when(F.col("c") == "R", F.array(F.lit(0), F.lit(1))).when(F.col("c") == "A", F.array(F.lit(0), F.lit(2))).when(F.col("c") == "D", F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    inner = c.select(F.col("h").alias("path_id"), "s", F.posexplode(ids).alias("k", "d")).select("path_id", "s", "k", (3 * F.col("s") + F.col("d")).alias("seg_id"))
    last = c.groupBy("h").agg((F.max("s") + 1).alias("s")).select(F.col("h").alias("path_id"), "s", F.lit(0).alias("k"), (3 * F.col("s")).alias("seg_id"))
    rows = inner.unionByName(last)
    steps = rows.select("path_id", (F.row_number().over(Window.partitionBy("path_id").orderBy("s", "k")) - 1).cast("bigint").alias("step_idx"), "seg_id", F.lit(">").alias("strand"))
    steps = written(steps, "steps")
    paths = steps.select("path_id").distinct().select("path_id", F.concat(F.lit("H"), F.col("path_id").cast("string"), F.lit("#1#chr1")).alias("name"))
    return Graph(*_from_steps(steps), paths, steps)


def _from_steps(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments and links that walks imply: a link per distinct pair of consecutive steps."""
    segments = steps.select("seg_id").distinct().select("seg_id", sequence_of("seg_id").alias("seq"))
    w = Window.partitionBy("path_id").orderBy("step_idx")
    pairs = steps.select(F.col("seg_id").alias("v1"), F.expr("IF(strand = '>', 'r', 'l')").alias("v1_end"), F.lead("seg_id").over(w).alias("v2"), F.expr("IF(lead(strand) OVER (PARTITION BY path_id ORDER BY step_idx) = '>', 'l', 'r')").alias("v2_end")).where("v2 IS NOT NULL").distinct()
    return segments, numbered(pairs, "v1", "v1_end", "v2", "v2_end", name="edge_idx").select("edge_idx", *pairs.columns)


#: Sites that a haplotype of levels() leaves out together.
BLOCK = 4


def levels(spark: SparkSession, sf_dir: str) -> Graph:
    """Backbone 3s, reference allele 3s + 1 and, at even sites, other allele 3s + 2; at odd sites the other allele is nothing.

    Every third haplotype leaves out some whole blocks of sites. Haplotype 0 has the reference allele everywhere,
    haplotype 1 the other one at each block's second site.
    """
    c = numbered(_table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", name="s")
    blocks = c.groupBy(F.expr(f"s div {BLOCK}").alias("b")).agg((F.count("*") == BLOCK).alias("full"))
    haps = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("h"))
    digit = lambda *x: F.substring(F.md5(F.concat_ws(":", *[F.col(y).cast("string") for y in x]).cast("binary")), 1, 1)
    out = (F.col("h") % 3 == 2) & F.col("full") & digit("b", "h").isin("0", "1", "2", "3")
    skip = blocks.join(F.broadcast(haps)).where(out).select("b", "h", F.lit(True).alias("skip"))
    own = c.withColumn("b", F.expr(f"s div {BLOCK}")).join(F.broadcast(haps)).join(skip, ["b", "h"], "left")
    other = (F.col("h") > 0) & (digit("h", "s_suppkey").isin("c", "d", "e") | ((F.col("h") == 1) & (F.col("s") % BLOCK == 1)))
    inner = F.when(~other, F.array(F.lit(0), F.lit(1))).when(F.col("s") % 2 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    ids = F.when(F.col("skip"), F.when(F.col("s") % BLOCK == 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))).otherwise(inner)
    rows = own.select(F.col("h").alias("path_id"), F.col("s"), F.explode(ids).alias("d")).select("path_id", (3 * F.col("s") + F.col("d")).alias("seg_id"))
    last = own.groupBy(F.col("h").alias("path_id")).agg((3 * F.max("s") + 3).alias("seg_id"))
    steps = rows.unionByName(last)
    steps = steps.select("path_id", (F.row_number().over(Window.partitionBy("path_id").orderBy("seg_id")) - 1).cast("bigint").alias("step_idx"), "seg_id", F.lit(">").alias("strand"))
    paths = haps.select(F.col("h").alias("path_id"), F.concat(F.lit("H"), F.col("h").cast("string"), F.lit("#1#chr1")).alias("name"))
    return Graph(*_from_steps(steps), paths, steps)


#: How far apart the copies of a small graph are numbered: segments and paths of the supplier of key k begin at k times these.
SEGMENTS_APART, PATHS_APART = 100, 10


def _dealt(keys: DataFrame) -> DataFrame:
    """keys(k) over all cores: their file is so small that Spark reads it in one task, which then makes all copies alone."""
    return keys.repartition(keys.sparkSession.sparkContext.defaultParallelism, "k")


def copies(spark: SparkSession, sf_dir: str, lines: list[str]) -> Graph:
    """A copy of a small graph per supplier: segments and paths shifted by its key, names behind it as name_key."""
    one = spark.createDataFrame(list(enumerate(lines)), gfa.LINES)
    k = _dealt(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")))
    each = lambda df: k.join(F.broadcast(df))  # noqa: E731  a few rows for each supplier
    far = lambda c: (F.lit(SEGMENTS_APART) * F.col("k") + F.col(c)).alias(c)
    path = (F.lit(PATHS_APART) * F.col("k") + F.col("path_id")).alias("path_id")
    return Graph(
        written(each(gfa.segments(one)).select(far("seg_id"), "seq"), "segments"),
        written(each(gfa.links(one)).select((F.lit(SEGMENTS_APART) * F.col("k") + F.col("edge_idx")).alias("edge_idx"), far("v1"), "v1_end", far("v2"), "v2_end"), "links"),
        written(each(gfa.paths(one)).select(path, F.concat_ws("_", "name", F.col("k").cast("string")).alias("name")), "paths"),
        written(each(gfa.steps(one)).select(path, "step_idx", far("seg_id"), "strand"), "steps"),
    )


def call_lines(spark: SparkSession, sf_dir: str, lines: list[str]) -> DataFrame:
    """(line_no, value): call lines of a small graph for each of its copies(): contigs and segments as there."""
    k = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    rows = [F.struct((F.lit(SEGMENTS_APART) * F.col("k") + i).alias("line_no"), shifted(line).alias("value")) for i, line in enumerate(lines)]
    return k.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def shifted(line: str) -> Column:
    """A call line with its contig and segments as the copy of k has them."""
    return F.concat(*[F.concat(F.lit(x[0]), (F.lit(SEGMENTS_APART) * F.col("k") + int(x[1:])).cast("string")) if re.fullmatch(_SEGMENT, x) else F.concat(F.lit("_"), F.col("k").cast("string"), F.lit("\t")) if x == _CONTIG_END else F.lit(x) for x in pieces(line)])


_SEGMENT, _CONTIG_END = "[<>][0-9]+", "_k\t"


def pieces(line: str) -> list[str]:
    """A call line cut before and after its segments and at its contig's end."""
    contig, _, rest = line.partition("\t")
    return [contig, _CONTIG_END, *[x for x in re.split(f"({_SEGMENT})", rest) if x]]


#: Small graphs, each with finer kinds of bubbles: segments from 0 on, links by side.
GADGETS = [
    [(0, "l", 0, "l"), (0, "r", 1, "l"), (0, "r", 3, "l"), (1, "r", 2, "l"), (1, "r", 3, "l"), (2, "r", 3, "l")],
    [(0, "r", 1, "l"), (1, "l", 0, "l"), (1, "r", 2, "l"), (1, "r", 3, "l"), (2, "r", 3, "l"), (3, "l", 4, "l"), (3, "r", 4, "l")],
    [(0, "r", 1, "l"), (1, "l", 0, "l"), (1, "r", 2, "l"), (1, "r", 3, "l"), (1, "r", 3, "r"), (2, "r", 3, "l"), (3, "r", 4, "l")],
    [(0, "r", 0, "l"), (0, "r", 1, "l"), (1, "r", 2, "l"), (1, "r", 3, "l"), (2, "r", 3, "l"), (3, "l", 4, "r"), (3, "r", 4, "l"), (4, "r", 5, "l"), (4, "r", 6, "l"), (5, "r", 6, "l")],
    [(0, "r", 1, "l"), (1, "r", 2, "l"), (2, "r", 3, "l"), (3, "l", 5, "l"), (3, "r", 5, "l"), (4, "l", 5, "l"), (4, "r", 3, "r"), (4, "r", 5, "l"), (5, "l", 5, "l")],
    [
        (0, "r", 0, "l"), (0, "r", 1, "l"), (1, "r", 2, "l"), (2, "r", 3, "l"), (2, "r", 4, "l"), (3, "r", 4, "l"), (4, "r", 1, "r"), (4, "r", 5, "l"), (4, "r", 5, "r"), (4, "r", 7, "l"),
        (5, "r", 6, "l"), (6, "r", 7, "l"), (7, "r", 8, "l"), (8, "r", 9, "l"), (9, "r", 10, "l"), (10, "l", 11, "l"), (10, "r", 11, "l"), (11, "r", 12, "l"),
    ],
    [(0, "r", 1, "l"), (0, "r", 2, "l"), (1, "r", 3, "l"), (1, "r", 4, "l"), (3, "r", 4, "l"), (4, "r", 5, "l"), (2, "r", 5, "l")],
]


def gadgets(spark: SparkSession, sf_dir: str) -> Graph:
    """A component per supplier: the small graph of its key modulo their number, segments from SEGMENTS_APART times its key on."""
    k = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % len(GADGETS)).alias("g"))
    rows = spark.createDataFrame([(g, i, *e) for g, links in enumerate(GADGETS) for i, e in enumerate(links)], "g long, i long, v1 long, v1_end string, v2 long, v2_end string")
    far = lambda c: (F.lit(SEGMENTS_APART) * F.col("k") + F.col(c)).alias(c)
    links = k.join(F.broadcast(rows), "g").select((F.lit(SEGMENTS_APART) * F.col("k") + F.col("i")).alias("edge_idx"), far("v1"), "v1_end", far("v2"), "v2_end")
    segments = links.select(F.col("v1").alias("seg_id")).unionByName(links.select(F.col("v2").alias("seg_id"))).distinct().select("seg_id", sequence_of("seg_id").alias("seq"))
    paths = spark.createDataFrame([], "path_id long, name string")
    return Graph(segments, links, paths, spark.createDataFrame([], "path_id long, step_idx long, seg_id long, strand string"))


def walks(spark: SparkSession, sf_dir: str) -> Graph:
    """A path per user through the types of its events in order of time: few segments, many loops."""
    e = _table(spark, sf_dir, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL")
    # a few kinds of events
    types = e.select("event_type").distinct().select("event_type", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("bigint").alias("seg_id"))
    steps = e.join(F.broadcast(types), "event_type").select(F.col("user_id").alias("path_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint").alias("step_idx"), "seg_id", F.lit(">").alias("strand"))
    paths = steps.select("path_id").distinct().select("path_id", F.concat(F.lit("user"), F.col("path_id").cast("string")).alias("name"))
    return Graph(*_from_steps(steps), paths, steps)


def orders(spark: SparkSession, sf_dir: str) -> Graph:
    """A path per order through its parts."""
    li = _table(spark, sf_dir, "lineitem")
    steps = li.select(F.col("l_orderkey").alias("path_id"), (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")) - 1).cast("bigint").alias("step_idx"), F.col("l_partkey").alias("seg_id"), F.lit(">").alias("strand"))
    paths = steps.select("path_id").distinct().select("path_id", F.concat(F.lit("order"), F.col("path_id").cast("string")).alias("name"))
    return Graph(*_from_steps(steps), paths, steps)
