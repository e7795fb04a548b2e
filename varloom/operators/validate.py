"""Calls held against the graph: every called allele's walk must occur on a haplotype of its genotype."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import parse_walk
from ..sources.vcf import genotype_entries, info
from . import graphs


REPORT_HEAD = "\t".join(("rec_idx", "ID", "POS", "AT", "Hap-ID", "sample"))


def check_calls(claims: DataFrame, steps: DataFrame) -> DataFrame:
    """claims(claim, path_id, at) with found: whether the path holds the walk at as steps in a row.

    The walk's tokens meet the path's steps by segment and direction; a start at which as many meet as the walk is long
    is an occurrence. An empty walk occurs everywhere.
    """
    c = claims.withColumn("w", parse_walk(F.col("at"))).withColumn("n", F.size("w"))
    token = c.select("claim", "path_id", "n", F.posexplode("w").alias("k", "t")).select("claim", "path_id", "n", "k", F.col("t.seg_id").alias("seg_id"), F.col("t.orient").alias("strand"))
    hit = token.join(steps, ["path_id", "seg_id", "strand"]).groupBy("claim", "n", (F.col("step_idx") - F.col("k")).alias("start")).agg(F.count("*").alias("m")).where("m = n").select("claim").distinct().withColumn("hit", F.lit(True))
    return c.join(hit, "claim", "left").select("claim", "path_id", "at", (F.coalesce("hit", F.lit(False)) | (F.col("n") == 0)).alias("found"))


def report(checked: DataFrame) -> DataFrame:
    """One row: claims, bad, and the error rate in percent (0 without claims)."""
    bad = F.sum(F.expr("CAST(NOT found AS BIGINT)"))
    return checked.agg(F.count("*").alias("claims"), F.coalesce(bad, F.lit(0)).alias("bad"), F.coalesce(100.0 * bad / F.count("*"), F.lit(0.0)).alias("error_rate"))


def claims_of_vcf(rec: DataFrame, paths: DataFrame) -> DataFrame:
    """claims for check_calls() of every called allele of sources.vcf.records(): (claim, line_no, sample_no, phase, path_id, at).

    A genotype's column and phase name a haplotype by the layout of genotype_columns(); its walk is the AT entry of its
    allele. A path whose name does not tell haplotypes stands for all phases of its sample. Genotypes of haplotypes
    that the graph lacks claim path -1, which holds nothing.
    """
    g = genotype_entries(rec)
    cols = graphs.genotype_columns(paths).join(graphs.path_names(paths).select("path_id", "format"), "path_id").withColumnRenamed("hap_col", "sample_no")
    told = cols.where("format = 'PANSN'").groupBy("sample_no", "phase").agg(F.min("path_id").alias("_of_phase"))
    untold = cols.where("format <> 'PANSN'").groupBy("sample_no").agg(F.min("path_id").alias("_of_all"))
    at = rec.select("line_no", F.posexplode(F.split(info("AT"), ",")).alias("allele", "at"))
    x = g.join(told, ["sample_no", "phase"], "left").join(untold, "sample_no", "left").withColumn("path_id", F.least("_of_phase", "_of_all")).join(at, ["line_no", "allele"], "left")
    return x.select(F.concat_ws(":", "line_no", "sample_no", "phase").alias("claim"), "line_no", "sample_no", "phase", F.coalesce("path_id", F.lit(-1)).alias("path_id"), F.coalesce("at", F.lit("")).alias("at"))


def failed_records(claims: DataFrame, checked: DataFrame) -> DataFrame:
    """(line_no, claim): the first claim of each record, by sample and phase, that does not hold."""
    bad = checked.where("NOT found").select("claim").join(claims, "claim")
    return bad.groupBy("line_no").agg(F.min_by("claim", F.struct("sample_no", "phase")).alias("claim"))


def report_lines(rec: DataFrame, claims: DataFrame, checked: DataFrame, paths: DataFrame) -> DataFrame:
    """(line_no, line): a row of the error report per record that fails, with record, id, place, walk, haplotype and sample."""
    first = failed_records(claims, checked).join(claims.drop("line_no"), "claim").join(rec.select("line_no", "id", "pos"), "line_no")
    who = graphs.path_names(paths).select("path_id", "hap_id").join(paths.select("path_id", "name"), "path_id")
    sample = graphs.genotype_columns(paths).select(F.col("hap_col").alias("sample_no"), "sample").distinct()
    rows = first.join(who, "path_id", "left").join(sample, "sample_no", "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return rows.select("line_no", F.concat_ws("\t", F.col("line_no").cast("string"), "id", F.col("pos").cast("string"), "at", text("hap_id"), text("sample")).alias("line"))


def summary_line(report: DataFrame) -> DataFrame:
    """(line) that says in words what report() counts."""
    return report.select(F.when(F.col("bad") == 0, "No errors").otherwise(F.format_string("Error rate: %.2f%%", "error_rate")).alias("line"))


def record_violations(rec: DataFrame) -> DataFrame:
    """(line_no, rule) of records whose fields break a rule.

    Empty names and alleles, places below 1, alleles beyond the list, allele numbers below 1, as many AC and AF as ALTs,
    AT one more, a kind that is none, equal ids.
    """
    n = F.size("alts")
    count = lambda k: F.size(F.split(F.coalesce(info(k), F.lit("")), ","))
    called = F.flatten(F.transform("gts", lambda g: F.split(g, "\\|")))
    rules = {
        "empty": (F.coalesce(F.col("chrom"), F.lit("")) == "") | (F.coalesce(F.col("id"), F.lit("")) == "") | (F.coalesce(F.col("ref"), F.lit("")) == "") | F.exists("alts", lambda a: a == ""),
        "place": F.coalesce(F.col("pos"), F.lit(0)) < 1,
        "allele": F.exists(called, lambda a: (a != ".") & (F.coalesce(a.try_cast("int"), F.lit(-1)).between(0, n) == F.lit(False))),
        "number": F.coalesce(info("AN").try_cast("bigint"), F.lit(0)) < 1,
        "counts": (count("AC") != n) | (count("AF") != n) | (count("AT") != n + 1),
        "kind": ~F.coalesce(info("VARTYPE"), F.lit("")).isin("SUB", "INS", "DEL", "SUBR"),
    }
    told = rec.select("line_no", F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())).alias("rule"))
    twice = rec.groupBy("chrom", "id", info("VARTYPE").alias("t")).agg(F.max("line_no").alias("line_no"), F.count("*").alias("n")).where("n > 1")
    return told.unionByName(twice.select("line_no", F.lit("repeated").alias("rule")))
