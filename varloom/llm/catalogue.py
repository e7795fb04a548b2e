"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding, html_text, manifest, minhash, packing, pii, quality, search, secrets, substring, toxicity, warc
from ._common import table
from .bpe import bpe_round_trip


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Rows and files of the sample on which op1 ranks its rules.
RULE_SAMPLE_ROWS, RULE_SAMPLE_FILES = 2000, 4


def op1_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = sorted(docs.inputFiles())
    some = spark.read.schema(docs.schema).parquet(*files[:: max(1, len(files) // RULE_SAMPLE_FILES)][:RULE_SAMPLE_FILES])
    sample = some.sample(min(1.0, RULE_SAMPLE_ROWS / max(1, some.count())), seed=11)
    return quality.quality_cascade(docs, sample).drop("rejected_by")


def op2_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("novel"))


def op6_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learn = toxicity.learn_part()
    model = toxicity.train(docs.where(learn), table(spark, sf_dir, "labels").where(learn))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(~learn, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def tampered():
    """Rows whose text op11 changes: 5 divides crc32 of the id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.dataset_manifest(table(spark, sf_dir, "documents"), altered=tampered())


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find_personal(docs, pii.train(docs))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in pii.BASE_KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


OP4_SQL = """
SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top
      FROM (SELECT page_id, html, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + ((CAST('0x' || substr(sha1(coalesce(html, '')), CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS INT), 1)), '') AS payload_digest FROM pages))
"""

OP6_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links,
       least(vec_id, coalesce((SELECT min(b) FROM r WHERE a = vec_id), vec_id)) AS component_id,
       vec_id <= coalesce((SELECT min(b) FROM r WHERE a = vec_id), vec_id) AS kept
FROM embeddings
"""

OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS p FROM w)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
s AS (SELECT w.doc_id, t, ws, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
             CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN n USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 100 * n_dup_lines > 50 * n_lines
            OR 100 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) < 70 * n_words
            OR len(list_filter(ws, lambda x: lower(x) IN (STOP))) < 2) AS kept
FROM s
""".replace("STOP", ", ".join(f"'{w}'" for w in quality.STOP_WORDS))


_H = "sha256(concat(" + ", ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', {c}) END" for c in ("doc_id", "source", "lang", "n_chars", "TEXT")) + "))"

OP11_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('s+' || source, 's') AS tree, LEAF AS leaf,
         CASE WHEN xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda x, b: list_reduce(list_prepend(xor(x, b), range(8)), lambda y, i: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 5 = 0 THEN OTHER ELSE LEAF END AS other
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM d),
n AS (SELECT tree, 0 AS lvl, pos, size, leaf AS digest FROM l
      UNION ALL
      SELECT tree, lvl + 1, pos // 16, (max(size) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM n WHERE size > 1 GROUP BY tree, lvl, pos // 16),
s AS MATERIALIZED (SELECT tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS size FROM n WHERE size = 1),
t AS (SELECT 0 AS lvl, pos, size, digest FROM s
      UNION ALL
      SELECT lvl + 1, pos // 16, (max(size) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE size > 1 GROUP BY lvl, pos // 16),
r AS MATERIALIZED (
  SELECT n.tree, lvl, n.pos // 16 AS up, list(n.digest ORDER BY n.pos) AS m, CASE WHEN max(n.size) <= 16 THEN 't' ELSE n.tree END AS ptree,
         CASE WHEN max(n.size) <= 16 THEN 0 ELSE lvl + 1 END AS plvl, CASE WHEN max(n.size) <= 16 THEN max(s.pos) ELSE n.pos // 16 END AS ppos
  FROM n JOIN s USING (tree) WHERE n.size > 1 GROUP BY n.tree, lvl, n.pos // 16
  UNION ALL
  SELECT 't', lvl, pos // 16, list(digest ORDER BY pos), 't', lvl + 1, pos // 16 FROM t WHERE size > 1 GROUP BY lvl, pos // 16),
p AS (SELECT doc_id, l.leaf, s.digest AS subroot, CASE WHEN l.size = 1 THEN 't' ELSE tree END AS tree, 0 AS lvl, CASE WHEN l.size = 1 THEN s.pos ELSE l.pos END AS pos, '' AS proof, other AS acc
      FROM l JOIN s USING (tree)
      UNION ALL
      SELECT doc_id, leaf, subroot, ptree, plvl, ppos, concat(proof, array_to_string(m[1 : pos % 16], ''), array_to_string(m[pos % 16 + 2 :], '')),
             sha256(concat(array_to_string(m[1 : pos % 16], ''), acc, array_to_string(m[pos % 16 + 2 :], '')))
      FROM p JOIN r ON p.tree = r.tree AND p.lvl = r.lvl AND p.pos // 16 = r.up)
SELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = t.digest AS verified
FROM p JOIN t ON t.size = 1 AND p.tree = 't' AND p.lvl = t.lvl
""".replace("LEAF", _H.replace("TEXT", "text")).replace("OTHER", _H.replace("TEXT", f"translate(text, '{manifest._UPPER}', '{manifest._LOWER}')"))


OP12_SQL = r"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'UPPER', 'LOWER'), 'TERM')) AS t FROM documents),
n AS MATERIALIZED (SELECT doc_id, CAST(count(*) AS BIGINT) AS n FROM terms GROUP BY doc_id),
a AS MATERIALIZED (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
tf AS MATERIALIZED (SELECT doc_id, t, CAST(count(*) AS BIGINT) AS tf FROM terms GROUP BY doc_id, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, a GROUP BY t, docs),
q AS (SELECT item_id, t, CAST(count(*) AS BIGINT) AS q
      FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'UPPER', 'LOWER'), 'TERM')) AS t FROM benchmark) GROUP BY item_id, t),
s AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words)))) AS BIGINT) AS score
      FROM q JOIN w USING (t) JOIN tf USING (t) JOIN n USING (doc_id), a GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
""".replace("TERM", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").replace("UPPER", manifest._UPPER).replace("LOWER", manifest._LOWER)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_quality_cascade": op1_quality_cascade,
        "op2_chunk_dedup": op2_chunk_dedup,
        "op3_bpe": op3_bpe,
        "op4_warc": op4_warc,
        "op5_secret_scan": op5_secret_scan,
        "op6_rp_forest": op6_rp_forest,
        "op7_html_text": op7_html_text,
        "op8_toxicity": op8_toxicity,
        "op9_minhash": op9_minhash,
        "op10_best_fit": op10_best_fit,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_ranked_search": op12_ranked_search,
        "op13_personal_data": op13_personal_data,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_cascade": OP1_SQL, "op4_warc": OP4_SQL, "op6_rp_forest": OP6_SQL, "op11_merkle_manifest": OP11_SQL, "op12_ranked_search": OP12_SQL}
