"""The pipeline's stages on a small corpus with planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    word = lambda n: " ".join(f"w{rng.randrange(50_000)}" for _ in range(n))
    rows = {i: word(rng.randrange(60, 200)) for i in range(400)}
    for i in range(0, 400, 8):
        rows[i] += " vileword " + word(5) + " nastyterm vileword"
    passage = word(70)
    rows[301] = word(40) + " " + passage + " " + word(40)
    rows[303] = word(40) + " " + passage + " " + word(40)
    rows[305] = rows[299]
    rows[307] = rows[297] + " extra"
    rows[309] = word(60) + " password=abc123def456 " + word(30)
    docs = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows.items()] + [(500, None, None, None, None), (501, "", "en", "x", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("score", F.lit("clash")).withColumn("spans", F.lit(1))
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        seen[name] = now
        if k < 4:
            assert now.columns == docs.columns
    left = {r.doc_id: r for r in seen["toxicity"].collect()}
    assert not [i for i in range(0, 400, 8) if i in left] and len(left) == 402 - 50
    left = {r.doc_id for r in seen["minhash_near_dedup"].collect()}
    assert left == {i for i in [*range(400), 500, 501] if i % 8 or i > 400} - {305, 307}
    text = {r.doc_id: r for r in seen["substring_dedup"].collect()}
    assert passage in text[301].text and passage not in text[303].text and text[303].n_chars == len(text[303].text)
    assert all(text[i].text == rows[i] for i in left if i in rows and i != 303)
    clean = {r.doc_id: r.text for r in seen["secret_scan"].collect()}
    assert "abc123def456" not in clean[309] and "[SECRET]" in clean[309]
    assert all(clean[i] == text[i].text for i in left if i != 309)
    packed = seen["best_fit_packing"].collect()
    assert {r.doc_id for r in packed} == left
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_through_the_stages(spark, tmp_path):
    rng = random.Random(5)
    word = lambda n: " ".join(f"w{rng.randrange(50_000)}" for _ in range(n))
    passage, long = word(80), word(60_000)
    rows = [(1, passage + " " + word(30), "en"), (2, long, "en"), (3, word(50), "en"), (3, None, "de"), (4, "", "en"), (4, "", "de")]
    rows[3] = (3, rows[2][1], "de")  # one id and text, other columns
    two = [(5, word(40) + " " + passage + " " + word(20), "en"), (5, word(90), "en")]  # one id, two texts
    none = [(None, passage, "en"), (None, passage, "en"), (None, None, None)]
    docs = spark.createDataFrame([(i, t, l, None, len(t or "")) for i, t, l in rows + two + none], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("rest", F.lit(1)).withColumn("_gone", F.lit("clash")).withColumn("_id", F.lit(7)).withColumn("_spans", F.lit(None).cast("string"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, out = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        now = spark.read.parquet(f"{tmp_path}/out{k}")
        assert now.columns == docs.columns
        out.append(sorted(((r.doc_id, r.text, r.lang) for r in now.collect()), key=repr))
    everything = sorted(rows + two + none, key=repr)
    left = sorted([rows[0], rows[1], (3, rows[2][1], "de"), (4, "", "de")] + two + none, key=repr)
    assert out[0] == everything and out[1] == left and out[2] == left and out[3] == left
    packed = corpus_pipeline.pack_sequences(spark, now, str(tmp_path)).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) and sum(r.doc_id is None for r in packed) == 3
