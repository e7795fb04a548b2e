"""GFA text as tables, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graphs

LINES = "line_no long, value string"
#: Where text() begins to number links and paths; segments have their own numbers.
LINK_NO, PATH_NO = 1 << 40, 1 << 41


class InvalidGfa(ValueError):
    """The input breaks a rule; the message tells the first lines that do."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a file or folder. Numbers grow with the place in the file; each file has its own block."""
    raw = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return raw.select("line_no", F.regexp_replace("value", "\r$", "").alias("value")).where("value <> ''")


def _fields(lines: DataFrame, kind: str) -> DataFrame:
    return lines.select("line_no", F.split("value", "\t").alias("f")).where(F.get("f", F.lit(0)) == kind)


def segments(lines: DataFrame) -> DataFrame:
    """(seg_id, seq)."""
    return _fields(lines, "S").select(F.get("f", F.lit(1)).try_cast("bigint").alias("seg_id"), F.get("f", F.lit(2)).alias("seq"))


def _ranked(df: DataFrame, name: str) -> DataFrame:
    """df with consecutive numbers by line_no: ranks within blocks of lines, blocks by their counts before them."""
    block = df.withColumn("_b", F.floor(F.col("line_no") / 1_000_000))
    before = block.groupBy("_b").count()
    before = before.select("_b", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_n"))
    return block.join(before, "_b").withColumn(name, (F.col("_n") + F.row_number().over(Window.partitionBy("_b").orderBy("line_no")) - 1).cast("bigint")).drop("_b", "_n")


def links(lines: DataFrame) -> DataFrame:
    """(edge_idx, v1, v1_end, v2, v2_end): a link leaves by r from + and by l from -, and enters the other way round."""
    f = F.col("f")
    rows = _ranked(_fields(lines, "L"), "edge_idx")
    return rows.select("edge_idx", F.get(f, F.lit(1)).try_cast("bigint").alias("v1"), F.when(F.get(f, F.lit(2)) == "+", "r").otherwise("l").alias("v1_end"), F.get(f, F.lit(3)).try_cast("bigint").alias("v2"), F.when(F.get(f, F.lit(4)) == "+", "l").otherwise("r").alias("v2_end"))


def _walks(lines: DataFrame) -> DataFrame:
    """(line_no, name, tokens) of P and W lines; tokens as >1 or <1."""
    f = F.col("f")
    p = _fields(lines, "P").select("line_no", F.get(f, F.lit(1)).alias("name"), F.transform(F.split(F.get(f, F.lit(2)), ","), lambda t: F.concat(F.when(t.endswith("+"), ">").otherwise("<"), F.regexp_replace(t, "[+-]$", ""))).alias("tokens"))
    span = F.when((F.get(f, F.lit(4)) == "*") | (F.get(f, F.lit(5)) == "*"), F.lit("")).otherwise(F.concat(F.lit(":"), F.get(f, F.lit(4)), F.lit("-"), F.get(f, F.lit(5))))
    w = _fields(lines, "W").select("line_no", F.concat(F.get(f, F.lit(1)), F.lit("#"), F.get(f, F.lit(2)), F.lit("#"), F.get(f, F.lit(3)), span).alias("name"), F.regexp_extract_all(F.get(f, F.lit(6)), F.lit("([<>][^<>]+)"), F.lit(1)).alias("tokens"))
    return _ranked(p.unionByName(w), "path_id")


def paths(lines: DataFrame) -> DataFrame:
    """(path_id, name) in the order of lines."""
    return _walks(lines).select("path_id", "name")


def steps(lines: DataFrame) -> DataFrame:
    """(path_id, step_idx, seg_id, strand)."""
    e = _walks(lines).select("path_id", F.posexplode("tokens").alias("step_idx", "t"))
    return e.select("path_id", F.col("step_idx").cast("bigint").alias("step_idx"), F.col("t").substr(F.lit(2), F.length("t")).try_cast("bigint").alias("seg_id"), F.col("t").substr(1, 1).alias("strand"))


def violations(lines: DataFrame) -> DataFrame:
    """(rule, line_no, detail): every breach of the accepted subset; line_no is null for rules on the whole file.

    Kinds H, S, L, P and W alone; S with a name and a sequence that is not *; names unique; six columns in L with a 0M
    overlap; four columns in P, seven in W; every end and step declared; every two steps in a row joined by a link; at
    least one segment and one path.
    """
    f = F.col("f")
    rows = lines.select("line_no", F.split("value", "\t").alias("f"))
    out = lambda df, rule, detail: df.select(F.lit(rule).alias("rule"), F.col("line_no").cast("bigint").alias("line_no"), detail.cast("string").alias("detail"))
    found = [
        out(rows.where(~F.get(f, F.lit(0)).isin("H", "S", "L", "P", "W")), "kind", F.get(f, F.lit(0))),
        out(rows.where((F.get(f, F.lit(0)) == "S") & ((F.size(f) < 3) | (F.get(f, F.lit(2)) == "") | (F.get(f, F.lit(2)) == "*"))), "segment", F.get(f, F.lit(1))),
        out(rows.where((F.get(f, F.lit(0)) == "L") & ((F.size(f) != 6) | (F.coalesce(F.get(f, F.lit(5)), F.lit("")) != "0M"))), "overlap", F.get(f, F.lit(5))),
        out(rows.where((F.get(f, F.lit(0)) == "P") & (F.size(f) < 4)), "path", F.get(f, F.lit(1))),
        out(rows.where((F.get(f, F.lit(0)) == "W") & (F.size(f) < 7)), "walk", F.get(f, F.lit(1))),
    ]
    named = rows.where((F.get(f, F.lit(0)) == "S") & (F.size(f) >= 2)).select("line_no", F.get(f, F.lit(1)).alias("name"))
    twice = named.groupBy("name").agg(F.max("line_no").alias("line_no"), F.count("*").alias("n")).where("n > 1")
    found.append(out(twice, "duplicate", F.col("name")))
    whole = rows.where((F.get(f, F.lit(0)) == "L") & (F.size(f) >= 5))
    ends = whole.select("line_no", F.get(f, F.lit(1)).alias("name")).unionByName(whole.select("line_no", F.get(f, F.lit(3)).alias("name")))
    found.append(out(ends.join(named.select("name").distinct(), "name", "left_anti").distinct(), "dangling_link", F.col("name")))
    walks = _walks(lines)
    token = walks.select("line_no", F.explode("tokens").alias("t")).select("line_no", F.col("t").substr(F.lit(2), F.length("t")).alias("name"))
    found.append(out(token.join(named.select("name").distinct(), "name", "left_anti").distinct(), "dangling_step", F.col("name")))
    loose = graphs.unsupported_steps(steps(lines), links(lines)).join(walks.select("path_id", "line_no"), "path_id")
    found.append(out(loose, "unsupported_step", F.col("step_idx")))
    for kinds, rule in ((("S",), "no_segment"), (("P", "W"), "no_path")):
        none = rows.agg(F.count(F.when(F.get(f, F.lit(0)).isin(*kinds), 1)).alias("n")).where("n = 0").select(F.lit(None).cast("bigint").alias("line_no"))
        found.append(out(none, rule, F.lit(None)))
    result = found[0]
    for x in found[1:]:
        result = result.unionByName(x)
    return result


def require_valid(lines: DataFrame) -> None:
    """Raise InvalidGfa if there is any violation."""
    bad = violations(lines).orderBy("line_no").take(5)
    if bad:
        raise InvalidGfa("Invalid GFA: " + "; ".join(f"{r.rule} {r.detail} (line {r.line_no})" for r in bad))


def text(segments: DataFrame, links: DataFrame, paths: DataFrame, steps: DataFrame, walks: Column | None = None) -> DataFrame:
    """(line_no, value): a graph as S, L and P lines, in this order and each kind by its numbers.

    Paths for which the condition `walks` on (path_id, name) holds become W lines, from 0 to their length; their names must
    be sample#hap#contig. A path's line holds all of its steps, so one row must have room for it.
    """
    tab = lambda *c: F.concat_ws("\t", *c)
    n = lambda c: F.col(c).cast("string")
    s = segments.select(F.col("seg_id").alias("line_no"), tab(F.lit("S"), n("seg_id"), "seq").alias("value"))
    sign = lambda side, plus: F.when(F.col(side) == plus, "+").otherwise("-")
    e = links.select((F.lit(LINK_NO) + F.col("edge_idx")).alias("line_no"), tab(F.lit("L"), n("v1"), sign("v1_end", "r"), n("v2"), sign("v2_end", "l"), F.lit("0M")).alias("value"))
    own = steps.join(segments.select("seg_id", F.length("seq").alias("len")), "seg_id", "left")
    rows = own.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("step_idx", "seg_id", "strand"))).alias("w"), F.sum("len").alias("len")).join(paths, "path_id")
    p = F.array_join(F.transform("w", lambda x: F.concat(x["seg_id"].cast("string"), F.when(x["strand"] == ">", "+").otherwise("-"))), ",")
    w = F.array_join(F.transform("w", lambda x: F.concat(x["strand"], x["seg_id"].cast("string"))), "")
    parts = F.split("name", "#")
    as_w = tab(F.lit("W"), F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.lit("0"), n("len"), w)
    as_p = tab(F.lit("P"), "name", p, F.lit("*"))
    rows = rows.select((F.lit(PATH_NO) + F.col("path_id")).alias("line_no"), (as_p if walks is None else F.when(walks, as_w).otherwise(as_p)).alias("value"))
    return s.unionByName(e).unionByName(rows)
