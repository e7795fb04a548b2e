"""Scalar functions on names, sequences and oriented walks, as Column expressions and as SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOKEN = "[<>][0-9]+"


def revcomp(seq: Column) -> Column:
    """Reverse complement. Only upper-case ACGT have complements; other letters stay as they are."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def pansn(name: Column) -> Column:
    """struct(format, sample, hap_id, contig): PANSN for sample#hap#contig with a whole number hap, else RAW."""
    parts = F.split(name, "#")
    ok = (F.size(parts) == 3) & F.get(parts, F.lit(1)).rlike("^[0-9]+$")
    return F.struct(
        F.when(ok, "PANSN").otherwise("RAW").alias("format"),
        F.when(ok, F.get(parts, F.lit(0))).otherwise(name).alias("sample"),
        F.when(ok, F.get(parts, F.lit(1)).try_cast("bigint")).alias("hap_id"),
        F.when(ok, F.get(parts, F.lit(2))).alias("contig"),
    )


def parse_walk(text: Column) -> Column:
    """array of struct(orient, seg_id) from text like >1<2; no tokens give an empty array."""
    tokens = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))
    return F.transform(tokens, lambda t: F.struct(t.substr(1, 1).alias("orient"), t.substr(F.lit(2), F.length(t)).cast("bigint").alias("seg_id")))


def walk_to_string(walk: Column) -> Column:
    return F.array_join(F.transform(walk, lambda t: F.concat(t["orient"], t["seg_id"].cast("string"))), "")


def flip(orient: Column) -> Column:
    return F.when(orient == ">", "<").when(orient == "<", ">")


def complement_side(side: Column) -> Column:
    return F.when(side == "l", "r").when(side == "r", "l")


def flip_walk(walk: Column) -> Column:
    return F.reverse(F.transform(walk, lambda t: F.struct(flip(t["orient"]).alias("orient"), t["seg_id"].alias("seg_id"))))


def forwardise(label: Column) -> Column:
    """<a<z becomes >z>a; other labels stay."""
    return F.regexp_replace(label, "^<([0-9]+)<([0-9]+)$", ">$2>$1")


def out_side(strand: Column) -> Column:
    """The side by which a step in the text form of a link (+ or -) leaves."""
    return F.when(strand == "+", "r").otherwise("l")


def in_side(strand: Column) -> Column:
    return F.when(strand == "+", "l").otherwise("r")


def reversed_link() -> list[Column]:
    """The columns of a link read from its other end."""
    return [F.col("edge_idx"), F.col("v2").alias("v1"), F.col("v2_end").alias("v1_end"), F.col("v1").alias("v2"), F.col("v1_end").alias("v2_end")]


def other_end(seg_id: Column, side: Column) -> Column:
    """struct(seg_id, side): where a link leads from one of its ends; null if this is none of its ends."""
    end = lambda v, e: F.struct(F.col(v).alias("seg_id"), F.col(e).alias("side"))
    return F.when((F.col("v1") == seg_id) & (F.col("v1_end") == side), end("v2", "v2_end")).when((F.col("v2") == seg_id) & (F.col("v2_end") == side), end("v1", "v1_end"))


def half_gap(a: Column, b: Column) -> Column:
    """Half the distance of two numbers, rounded up from distance + 1."""
    return F.floor((F.abs(a - b) + 1) / 2).cast("bigint")


def id_interval(label: Column) -> Column:
    """struct(lo, hi) of the two segment ids in a label."""
    ids = F.transform(F.regexp_extract_all(label, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("bigint"))
    return F.struct(F.array_min(F.slice(ids, 1, 2)).alias("lo"), F.array_max(F.slice(ids, 1, 2)).alias("hi"))


def covariant(var_type: Column) -> Column:
    """The type seen from the other allele."""
    return F.when(var_type == "INS", "DEL").when(var_type == "DEL", "INS").otherwise(var_type)


def shortest(x: Column) -> Column:
    """A double's shortest decimal that reads back the same; whole numbers without a fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def register(spark: SparkSession) -> None:
    """revcomp, flip_orient, forwardise, walk_tokens and pansn_sample for SQL, as SQL functions that Catalyst inlines."""
    for body in (
        "revcomp(s STRING) RETURNS STRING RETURN reverse(translate(s, 'ACGT', 'TGCA'))",
        "flip_orient(o STRING) RETURNS STRING RETURN CASE o WHEN '>' THEN '<' WHEN '<' THEN '>' END",
        "forwardise(l STRING) RETURNS STRING RETURN regexp_replace(l, '^<([0-9]+)<([0-9]+)$', '>$2>$1')",
        "walk_tokens(w STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(w, '([<>][0-9]+)', 1)",
        "pansn_sample(n STRING) RETURNS STRING RETURN CASE WHEN n RLIKE '^[^#]*#[0-9]+#[^#]*$' THEN split(n, '#')[0] ELSE n END",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
