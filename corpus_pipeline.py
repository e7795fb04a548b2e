"""A corpus pipeline: toxicity, near-duplicates, repeated passages, secrets, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet in the shared folder and reads again for the next. All but the last return the columns of documents (doc_id,
text, lang, source, n_chars) and any others that docs had; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import minhash, packing, secrets, substring, toxicity
from varloom.llm._common import table, written
from varloom.llm.catalogue import tokenizer_path


def _with_text(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like` in their order, n_chars counted anew."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def _folded(docs: DataFrame) -> tuple[DataFrame, list]:
    """docs as doc_id, text and one struct of its other columns, whose names then clash with nothing; and the way back."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    back = [F.col("_rest").getField(c).alias(c) if c in rest else F.col(c) for c in docs.columns]
    other = F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))
    return docs.select("doc_id", "text", other.alias("_rest")), back


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not predict to be toxic. Labels of the learning part alone train it.

    Every row is judged by its own text: null texts as empty ones, rows without an id and repeated rows like others.
    """
    learn = toxicity.learn_part()
    model = toxicity.train(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    folded, back = _folded(docs)
    return toxicity.score(folded, model, keep=("text", "_rest")).where("predicted = 0").select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id.

    Documents without an id, and those without words, stay. Of rows that repeat with one id and text, one stays: that
    whose other columns come first as JSON. An id that repeats with different texts is one document: its texts stay or
    go together.
    """
    gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id")
    twice = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id").join(gone, "doc_id", "left_anti"), "repeated_ids")
    once = docs.join(gone.unionByName(twice), "doc_id", "left_anti").select(*docs.columns)
    folded, back = _folded(docs)
    again = folded.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by("_rest", F.to_json("_rest")).alias("_rest"))
    return once.unionByName(again.select(*back))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that a document of smaller id holds too.

    Texts of documents without an id, and of ids that repeat with different texts, stay whole; null stays null.
    """
    return _with_text(substring.without_passages(docs, substring.repeated_passages(docs)), docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with [SECRET] in place of each secret. Each row by itself; null stays null."""
    folded, back = _folded(docs)
    clean = secrets.find_secrets(folded, redacted=True, keep=("_rest",)).withColumnRenamed("redacted", "text")
    return _with_text(clean.select(*back), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in sequences; a null or empty text is its end token alone.

    Small batches: the workers still hold what earlier stages left in their memory.
    """
    return packing.pack_documents(docs, tokenizer_path(), batch_rows=1000, cache_entries=20_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: No stage but the counting ones can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
