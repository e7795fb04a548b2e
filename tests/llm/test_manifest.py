"""The Merkle manifest against a plain tree in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from varloom.llm import catalogue, manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree int, pos string, leaf string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(d, source, lang, n, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, text)))


def climb(leaves):
    """(digest at the end, siblings of each leaf on the way, as (left, right) per level)."""
    level, who, ways = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(level) > 1:
        up, above = [], []
        for a in range(0, len(level), 16):
            run = level[a : a + 16]
            for i in range(len(run)):
                for leaf in who[a + i]:
                    ways[leaf].append(("".join(run[:i]), "".join(run[i + 1 :])))
            up.append(sha("".join(run)))
            above.append(sum(who[a : a + 16], []))
        level, who = up, above
    return level[0], ways


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    """Rows of the query for (doc_id, source, lang, n_chars, text) with different ids."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0))
        trees.append((own, *climb([leaf_of(*r) for r in own])))
    root, top = climb([t[1] for t in trees])
    out = []
    for (own, sub, ways), over in zip(trees, top):
        for r, way in zip(own, ways):
            proof = way + over
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            at = leaf_of(*r[:4], lowered(r[4])) if tampered else leaf_of(*r)
            for b, a in proof:
                at = sha(b + at + a)
            out.append((r[0], leaf_of(*r), sub, root, sha("".join(b + a for b, a in proof)), at, at == root))
    return sorted(out, key=str)


def run(spark, rows, schema=SCHEMA, fill=(7, "p", "l")):
    docs = spark.createDataFrame([(*r, *fill) for r in rows], schema)
    got = manifest.dataset_manifest(docs, altered=catalogue.tampered())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def rows_of(rng, sizes):
    ids = rng.sample(range(10**6), sum(sizes.values()))
    out = []
    for source, n in sizes.items():
        out += [(ids.pop(), source, rng.choice(["en", None]), rng.choice([5, None]), rng.choice([None, "", "Abc É", "lower", "X" * 300])) for _ in range(n)]
    return out


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1},
        {"a": 16},
        {"a": 17},
        {"a": 300},
        {"a": 1, "b": 1},
        {None: 3, "": 2, "é": 1, "z": 40, "a": 257},
        {f"s{i}": 1 + i % 3 for i in range(40)},
        {"hot": 4200, "b": 20, **{f"s{i}": 1 for i in range(300)}},
    ],
)
def test_manifest_is_the_plain_tree(spark, sizes):
    rows = rows_of(random.Random(len(sizes)), sizes)
    assert run(spark, rows) == plain(rows)


def test_odd_rows(spark):
    assert run(spark, []) == []
    rows = [(None, None, None, None, None), (1, "a", None, 3, ""), (2, "a", "en", 3, "ABC" * 40_000)]
    assert run(spark, rows) == plain(rows)
    same = [(1, "a", "en", 3, "Text")] * 40 + [(1, "a", "en", 3, "other")] * 2
    got = run(spark, same)
    assert len(got) == 42 and len({r[3] for r in got}) == 1 and {r[1] for r in got} == {leaf_of(*same[0]), leaf_of(*same[-1])}
    assert all(r[6] for r in got if zlib.crc32(b"1") % 5)


def test_tampering_is_seen(spark):
    rows = [(i, "a", "en", 1, "Big Letters" if i % 2 else "small") for i in range(200)]
    got = {r[0]: r[6] for r in run(spark, rows)}
    hit = {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, ok in got.items() if not ok} == {i for i in hit if i % 2} and hit


def test_hot_group_is_dealt_over_copies(spark, monkeypatch):
    monkeypatch.setattr(manifest, "SHARE", 3)
    rows = rows_of(random.Random(5), {"hot": 3000, "b": 5, "c": 1})
    assert run(spark, rows) == plain(rows)


def test_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    sql = con.sql(catalogue.oracle_sql()["op11_merkle_manifest"])
    got = catalogue.op11_merkle_manifest(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(sql.select(*got.columns).fetchall())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(map(tuple, got.collect()), key=str) == plain([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert got.where(~F.col("verified")).count() > 0
