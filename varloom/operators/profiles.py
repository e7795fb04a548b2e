"""Rewritten call sets: top level only, popped, left-normalised, decomposed. Rows as sources.vcf.records() gives them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import id_interval, shortest
from ..sources.vcf import info


def _with(*pairs: tuple[str, Column]) -> Column:
    """info with key=value texts added at its end."""
    return F.concat("info", F.array(*[F.concat(F.lit(k + "="), v) for k, v in pairs]))


def _set(of: Column, key: str, value: Column) -> Column:
    return F.transform(of, lambda x: F.when(F.startswith(x, F.lit(key + "=")), F.concat(F.lit(key + "="), value)).otherwise(x))


def _project(gts: Column, alt: Column) -> Column:
    """Genotypes as seen by one ALT: it becomes 1, the reference stays 0, everything else is missing."""
    one = lambda a: F.when(a == alt.cast("string"), "1").when(a == "0", "0").otherwise(".")
    return F.transform(gts, lambda g: F.array_join(F.transform(F.split(g, "\\|"), one), "|"))


def _recount(of: Column, gts: Column) -> Column:
    called = F.size(F.filter(gts, lambda g: g != ".")).cast("bigint")
    ones = F.size(F.filter(gts, lambda g: g == "1")).cast("bigint")
    of = _set(of, "AC", ones.cast("string"))
    of = _set(of, "AF", shortest(ones / called))
    return _set(_set(of, "AN", called.cast("string")), "NS", called.cast("string"))


class ProfileRejected(ValueError):
    """The calls of this graph have no form in the profile."""


def raw_graph(rec: DataFrame, tree: DataFrame, steps: DataFrame, refs: DataFrame) -> DataFrame:
    """The calls as they are. Raises ProfileRejected if a nested bubble's ends are on none of refs(path_id), as it has no place there."""
    on = steps.join(refs.select("path_id").distinct(), "path_id").select("path_id", "seg_id").distinct()
    placed = tree.join(on.withColumnRenamed("seg_id", "start_id"), "start_id").select("comp_id", "i", "j", "path_id", F.col("end_id").alias("seg_id")).join(on, ["path_id", "seg_id"])
    lost = tree.where("parent_lo IS NOT NULL").join(placed, ["comp_id", "i", "j"], "left_anti").take(1)
    if lost:
        raise ProfileRejected(f"nested bubble {lost[0].label} has no place on a chosen reference")
    return rec


def inserted_path_raw(rec: DataFrame) -> DataFrame:
    """Coordinates on inserted paths are not defined: raises ProfileRejected whatever the calls."""
    raise ProfileRejected("coordinates on inserted paths are not defined")


def top_level(rec: DataFrame) -> DataFrame:
    """Reversals and calls of level 0."""
    kept = rec.where((info("VARTYPE") == "SUBR") | (info("LV") == "0"))
    return kept.withColumn("info", _with(("ORIGIN", F.col("id")), ("PROFILE", F.lit("top-level-only")), ("PASSTHROUGH", F.lit("T")))).withColumn("id", F.concat("id", F.lit(":top")))


def popped(rec: DataFrame, max_level: int = 0, max_ref: int = 4, max_alt: int = 4) -> DataFrame:
    """Large calls up to max_level give way to the small calls whose ids lie inside theirs; other small ones stay.

    Intervals meet through their exact bounds in bins of 2 ** k ids, as a parent can only hold what starts inside it.
    """
    big = (F.length("ref") > max_ref) | F.exists("alts", lambda a: F.length(a) > max_alt)
    level = F.coalesce(info("LV").cast("int"), F.lit(0))
    r = rec.withColumn("_big", big).withColumn("_lv", level).withColumn("_span", id_interval(F.col("id")))
    stay = r.where((F.col("_lv") <= max_level) & ~F.col("_big")).select(*rec.columns)
    width = lambda lo, hi: F.floor(F.log2(F.greatest(F.lit(1), hi - lo))).cast("int")
    at = lambda x, k: F.floor(x / F.pow(F.lit(2.0), k + 1)).cast("bigint")
    lo, hi = F.col("_span.lo"), F.col("_span.hi")
    parent = r.where((F.col("_lv") <= max_level) & F.col("_big")).select(F.col("id").alias("_pid"), lo.alias("_plo"), hi.alias("_phi"), width(lo, hi).alias("_k"))
    parent = parent.select("*", F.explode(F.array_distinct(F.array(at(F.col("_plo"), F.col("_k")), at(F.col("_phi"), F.col("_k"))))).alias("_bin"))
    child = r.where((F.col("_lv") > max_level) & ~F.col("_big")).select(*rec.columns, lo.alias("_lo"), hi.alias("_hi"), F.explode(F.sequence(F.lit(0), F.lit(40))).alias("_k"))
    child = child.withColumn("_bin", at(F.col("_lo"), F.col("_k")))
    hit = child.join(parent, ["_k", "_bin"]).where("_plo <= _lo AND _hi <= _phi")
    best = hit.groupBy("line_no").agg(F.min(F.struct((F.col("_phi") - F.col("_plo")).alias("n"), F.col("_pid").alias("p"))).alias("m")).select("line_no", F.col("m.p").alias("_pid"))
    saved = rec.join(best, "line_no").withColumn("info", _with(("ORIGIN", F.col("id")), ("PARENT", F.col("_pid")), ("PROFILE", F.lit("popped")), ("RESCUED_CHILD", F.lit("T")), ("POPPED_PARENT", F.col("_pid")))).withColumn("id", F.concat("id", F.lit(":rescued"))).select(*rec.columns)
    return stay.unionByName(saved)


def left_align(reference: str, pos: int, ref: str, alt: str) -> tuple[int, str, str]:
    """An insertion or deletion moved left while the base before it equals the longer allele's last."""
    while pos > 1 and len(ref) != len(alt):
        longer = ref if len(ref) > len(alt) else alt
        before = reference[pos - 2]
        if longer[-1] != before:
            break
        ref, alt, pos = before + ref[:-1], before + alt[:-1], pos - 1
    return pos, ref, alt


def left_normalised(rec: DataFrame, fasta: DataFrame) -> DataFrame:
    """Calls with one ALT at their leftmost place on fasta(name, sequence). Multi-ALT calls raise.

    Sequences join by name; a lone sequence serves every call, and of several a call whose contig is not among them
    raises. A task walks one call at a time, over the bases to its left.
    """
    known = [r[0] for r in fasta.select("name").limit(2).collect()]
    cols = rec.columns
    one = rec.withColumn("_alt", F.when(F.size("alts") == 1, F.get("alts", F.lit(0))).otherwise(F.raise_error(F.lit("left normalisation takes one ALT a record"))))
    on = F.lit(known[0]) if len(known) == 1 else F.col("chrom")
    both = one.withColumn("_on", on).join(fasta.select(F.col("name").alias("_on"), F.col("sequence").alias("_seq")), "_on", "left")
    both = both.withColumn("_seq", F.coalesce("_seq", F.raise_error(F.concat(F.lit("no sequence for "), F.col("chrom")))))

    @F.pandas_udf("pos long, ref string, alt string")
    def move(seq, pos, ref, alt):
        import pandas as pd

        return pd.DataFrame([left_align(s, int(p), r, a) for s, p, r, a in zip(seq, pos, ref, alt)], columns=["pos", "ref", "alt"])

    moved = both.withColumn("_m", move(F.substring("_seq", F.lit(1), F.col("pos").cast("int")), "pos", "ref", "_alt"))
    changed = F.when((F.col("_m.pos") != F.col("pos")), "T").otherwise("F")
    tags = _with(("ORIGIN", F.col("id")), ("RAW_ALT_INDEX", F.lit("1")), ("PROFILE", F.lit("left-normalized")), ("LEFT_NORMALIZED", changed), ("RAW_POS", F.col("pos").cast("string")), ("RAW_REF", F.col("ref")), ("RAW_ALT", F.col("_alt")))
    out = moved.withColumn("info", tags).withColumn("id", F.concat("id", F.lit(":norm"))).withColumn("pos", F.col("_m.pos")).withColumn("ref", F.col("_m.ref")).withColumn("alts", F.array("_m.alt"))
    return out.select(*cols)


def decomposed(rec: DataFrame, max_alt: int = 8) -> DataFrame:
    """A record per mismatching base of each short ALT; reversals and long ALTs pass through, one record per ALT."""
    one = rec.select(*rec.columns, F.posexplode("alts").alias("_k", "_alt"), info("VARTYPE").alias("_type"), F.split(info("AT"), ",").alias("_at")).withColumn("_n", F.col("_k") + 1)
    origin = [("ORIGIN", F.col("id")), ("RAW_ALT_INDEX", F.col("_n").cast("string")), ("PROFILE", F.lit("decomposed"))]
    raw = [("RAW_POS", F.col("pos").cast("string")), ("RAW_REF", F.col("ref")), ("RAW_ALT", F.col("_alt"))]
    bare = F.filter("info", lambda x: ~F.startswith(x, F.lit("ES=")) & ~F.startswith(x, F.lit("LV=")))
    text = lambda pairs: F.array(*[F.concat(F.lit(k + "="), v) for k, v in pairs])
    rev = one.where("_type = 'SUBR'").withColumn("info", F.concat("info", text([*origin, ("PASSTHROUGH", F.lit("T")), ("PASS_THROUGH_REASON", F.lit("subr_inversion_preservation")), ("SUBR_ORIGIN", F.lit("T"))]))).withColumn("id", F.concat("id", F.lit(":subr-passthrough"))).select(*rec.columns)
    rest = one.where("_type <> 'SUBR'").withColumn("gts", _project(F.col("gts"), F.col("_n")))
    walk = F.concat_ws(",", F.get("_at", F.lit(0)), F.get("_at", F.col("_n")))
    long = rest.where(F.length("_alt") > max_alt)
    kept = _set(_set(_recount(bare, F.col("gts")), "AT", walk), "TANGLED", F.lit("T"))
    long = long.withColumn("info", F.concat(kept, text([*origin, ("PASSTHROUGH", F.lit("T")), ("PASS_THROUGH_REASON", F.lit("max_allele_length")), *raw]))).withColumn("id", F.concat("id", F.lit(":"), F.col("_n").cast("string"), F.lit(":passthrough"))).withColumn("alts", F.array("_alt")).select(*rec.columns)
    letters = lambda c: F.split(c, "")
    differ = F.filter(F.transform(F.zip_with(letters("ref"), letters("_alt"), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x, i: F.struct(i.alias("i"), x["a"].alias("a"), x["b"].alias("b"))), lambda x: x["a"] != x["b"])
    snp = rest.where(F.length("_alt") <= max_alt).select("*", F.posexplode(differ).alias("_j", "_x"))
    step = lambda i: F.get(F.regexp_extract_all(F.get("_at", i), F.lit("([<>][0-9]+)"), F.lit(1)), F.col("_x.i"))
    kept = _set(_set(_recount(bare, F.col("gts")), "AT", F.concat_ws(",", step(F.lit(0)), step(F.col("_n")))), "TANGLED", F.lit("F"))
    tags = F.concat(kept, text([*origin, ("DECOMPOSED", F.lit("T")), *raw]))
    snp = snp.withColumn("info", tags).withColumn("id", F.concat("id", F.lit(":"), F.col("_n").cast("string"), F.lit(":snp"), (F.col("_j") + 1).cast("string"))).withColumn("pos", F.col("pos") + F.col("_x.i")).withColumn("ref", F.col("_x.a")).withColumn("alts", F.array("_x.b")).select(*rec.columns)
    return rev.unionByName(long).unionByName(snp)


def provenance(out: DataFrame, profile: str) -> DataFrame:
    """(json): for every record of a rewritten set what it came from and how."""
    operation = F.when(info("RESCUED_CHILD") == "T", "rescue").when(info("PASSTHROUGH") == "T", "passthrough").when(info("LEFT_NORMALIZED").isNotNull(), "left_normalize").when(info("DECOMPOSED") == "T", "decompose").otherwise("keep")
    return out.select(F.to_json(F.struct(F.lit(profile).alias("profile"), operation.alias("operation"), F.coalesce(info("ORIGIN"), F.col("id")).alias("raw_record_id"), F.coalesce(info("RAW_ALT_INDEX"), F.lit("1")).cast("int").alias("raw_alt_index"), info("RAW_POS").cast("bigint").alias("raw_pos"), info("RAW_REF").alias("raw_ref"), info("RAW_ALT").alias("raw_alt"), F.col("id").alias("output_record_id"), F.col("pos").alias("output_pos"), F.col("ref").alias("output_ref"), F.col("alts").alias("output_alts"))).alias("json"))
