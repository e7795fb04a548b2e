"""VCF text as a table and back. INFO keeps its order: an array of key=value texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a file or folder."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", "\r$", "").alias("value"))


def samples(lines: DataFrame) -> list[str]:
    """Sample names of the column header; raises ValueError without one, or if the version is not 4.2."""
    head = [r[0] for r in lines.where(F.startswith("value", F.lit("#CHROM")) | F.startswith("value", F.lit("##fileformat"))).select("value").limit(8).collect()]
    if not any(x == "##fileformat=VCFv4.2" for x in head):
        raise ValueError("not VCF 4.2")
    cols = next((x.split("\t") for x in head if x.startswith("#CHROM")), [])
    if len(cols) < 10:
        raise ValueError("no sample columns")
    return cols[9:]


def records(lines: DataFrame) -> DataFrame:
    """(line_no, chrom, pos, id, ref, alts, info, gts) of the lines that don't begin with #."""
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    body = lines.where("value <> '' AND NOT value LIKE '#%'")
    return body.select("line_no", at(0).alias("chrom"), at(1).cast("bigint").alias("pos"), at(2).alias("id"), at(3).alias("ref"), F.split(at(4), ",").alias("alts"), F.split(at(7), ";").alias("info"), F.slice(f, 10, 1 << 20).alias("gts"))


def field_violations(lines: DataFrame, fields: int) -> DataFrame:
    """(line_no, fields) of record lines that have another number of tab-separated fields."""
    n = F.size(F.split("value", "\t")).cast("bigint")
    return lines.where("value <> '' AND NOT value LIKE '#%'").select("line_no", n.alias("fields")).where(F.col("fields") != fields)


def read(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """(samples, records()) of a VCF 4.2 file. Raises ValueError where a record has not nine fields and one for each sample."""
    lines = read_lines(spark, path)
    names = samples(lines)
    bad = field_violations(lines, 9 + len(names)).orderBy("line_no").take(3)
    if bad:
        raise ValueError(f"{9 + len(names)} fields a record: " + ", ".join(f"{r.fields} in line {r.line_no}" for r in bad))
    return names, records(lines)


def info(key: str, of: Column | str = "info") -> Column:
    """The value of an INFO key, null if absent."""
    of = F.col(of) if isinstance(of, str) else of
    return F.get(F.transform(F.filter(of, lambda x: F.startswith(x, F.lit(key + "="))), lambda x: x.substr(F.lit(len(key) + 2), F.length(x))), F.lit(0))


def genotype_entries(rec: DataFrame) -> DataFrame:
    """(line_no, sample_no, phase, allele): called alleles alone."""
    cell = rec.select("line_no", F.posexplode("gts").alias("sample_no", "g"))
    return cell.select("line_no", F.col("sample_no").cast("bigint").alias("sample_no"), F.posexplode(F.split("g", "\\|")).alias("phase", "a")).where("a <> '.'").select("line_no", "sample_no", F.col("phase").cast("bigint").alias("phase"), F.col("a").cast("bigint").alias("allele"))


def line(chrom: str = "chrom", pos: str = "pos", id: str = "id", ref: str = "ref", alts: str = "alts", info: str = "info", gts: str = "gts") -> Column:
    return F.concat_ws("\t", F.col(chrom), F.col(pos).cast("string"), F.col(id), F.col(ref), F.array_join(alts, ","), F.lit("60"), F.lit("PASS"), F.array_join(info, ";"), F.lit("GT"), F.array_join(gts, "\t"))


def header(names: list[str], more: tuple[tuple[str, str, str, str], ...] = ()) -> list[str]:
    """Header lines without contigs, the column line last; more INFO keys as (key, number, type, description)."""
    keys = [("AC", "A", "Integer"), ("AF", "A", "Float"), ("AN", "1", "Integer"), ("NS", "1", "Integer"), ("AT", "R", "String"), ("VARTYPE", "1", "String"), ("TANGLED", "1", "String"), ("ES", "1", "String"), ("LV", "1", "Integer")]
    told = {"AC": "Alternate allele counts", "AF": "Alternate allele frequencies", "AN": "Called haplotypes", "NS": "Samples with data", "AT": "Walks of the alleles", "VARTYPE": "Kind of variant", "TANGLED": "Whether the region is revisited", "ES": "Enclosing site", "LV": "Depth of the site"}
    out = ["##fileformat=VCFv4.2", "##source=varloom", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">']
    out += [f'##INFO=<ID={k},Number={n},Type={t},Description="{told[k]}">' for k, n, t in keys]
    out += [f'##INFO=<ID={k},Number={n},Type={t},Description="{d}">' for k, n, t, d in more]
    return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]


#: The order of a set's lines: header, contigs in their order, then place, the segments of the site's ends, and kind.
ORDER = ("part", "contig", "pos", "first", "last", "kind")


def ordered(lines: DataFrame, head: list[str], contigs: DataFrame) -> DataFrame:
    """Call lines (chrom, pos, id, vartype, line) and their header, with ORDER's columns.

    contigs: (k, chrom, length), k their order, in which they stand in the header too. Calls on other contigs come last.
    Kinds stand as SUB, INS, DEL, SUBR, others after them.
    """
    spark = lines.sparkSession
    zero = {"contig": "bigint", "pos": "bigint", "first": "bigint", "last": "bigint", "kind": "int"}
    top = spark.createDataFrame([(0 if i + 1 < len(head) else 2, i, x) for i, x in enumerate(head)], "part int, contig long, line string")
    named = contigs.select(F.lit(1).alias("part"), F.col("k").alias("contig"), F.concat(F.lit("##contig=<ID="), "chrom", F.lit(",length="), F.col("length").cast("string"), F.lit(">")).alias("line"))
    heads = top.unionByName(named).select("part", "contig", *[F.lit(0).cast(t).alias(c) for c, t in zero.items() if c != "contig"], "line")
    span = F.regexp_extract_all("id", F.lit("[<>]([0-9]+)"), F.lit(1))
    end = lambda i: F.coalesce(F.get(span, F.lit(i)).try_cast("bigint"), F.lit(-1))
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, ("SUB", "INS", "DEL", "SUBR"))), F.col("vartype")), F.lit(0)).cast("int")
    body = lines.join(contigs.select("chrom", F.col("k").alias("contig")), "chrom", "left")
    body = body.select(F.lit(3).alias("part"), F.coalesce("contig", F.lit((1 << 63) - 1)).alias("contig"), "pos", end(0).alias("first"), end(1).alias("last"), F.when(kind == 0, 9).otherwise(kind).alias("kind"), "line")
    return heads.select(*ORDER, "line").unionByName(body.select(*ORDER, "line"))


def write(lines: DataFrame, head: list[str], contigs: DataFrame, path: str) -> None:
    """Text files of ordered() lines, range-sorted.

    Files are cut by range, so nothing is gathered in one task; their names sort as their ranges do, so that one after
    the other they are one VCF file, whose lines stand in ORDER. Without calls there is the header alone.
    """
    keys = (*ORDER, "line")
    ordered(lines, head, contigs).repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.col("line").alias("value")).write.text(path)
