"""Ranked search against scores of every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from varloom.llm import catalogue, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string, id long, score int, terms string", "item_id long, text string, rank string"


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    bags = [(d, Counter(words(t))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    n_docs, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in bags:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if c[t])
            if s > 0:
                scored.append((-s, d is not None, d or 0, d, s))
        out += [(item, rank + 1, d, s) for rank, (*_, d, s) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, 1, 2, "x") for r in docs], DOCS)
    i = spark.createDataFrame([(*r, "y") for r in items], ITEMS)
    got = search.ranked(d, i, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(rng, n, vocabulary=60):
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(rng.choices([f"w{j}" for j in range(vocabulary)], weights, k=int(rng.paretovariate(1)) * 3))) for i in range(n)]


def test_terms_are_the_matches():
    for text in ("Abc-dÉf_x9\x7fÜ　y", "", "  ", "ÀÉ A-Z İIı", "a\x00b", "1.2e5", "\U0001f600a"):
        assert [t.decode() for t in search.terms(text.encode())] == words(text)


@pytest.mark.parametrize("shard", [1, 300, 10**9])
def test_ranks_of_all_documents(spark, shard):
    rng = random.Random(3)
    docs = corpus(rng, 700)
    docs += [(1000 + i, docs[i % 5][1]) for i in range(80)]  # ties
    items = [(i, " ".join(rng.choices([f"W{j}" for j in range(70)], k=rng.randrange(1, 25)))) for i in range(30)]
    items += [(100 + i, docs[i][1]) for i in range(5)]
    assert run(spark, docs, items, shard_places=shard) == plain(docs, items)


def test_blocks_of_items(spark):
    rng = random.Random(4)
    docs, items = corpus(rng, 120), [(i, f"w{i} w{i + 1} absent w0") for i in range(12)]
    assert run(spark, docs, items, terms_at_once=5) == plain(docs, items)


def test_odd_rows(spark):
    docs = [(None, "alpha beta"), (1, None), (2, ""), (3, " ... "), (4, "alpha"), (5, "alpha"), (6, "É é e beta " * 30_000), (7, "gamma")]
    items = [(None, "alpha"), (1, None), (2, ""), (3, "nothing here"), (4, "ALPHA alpha Beta É"), (5, "beta beta beta")]
    assert run(spark, docs, items) == plain(docs, [i for i in items if i[1]])
    assert run(spark, [], items) == [] and run(spark, docs, []) == [] and run(spark, [(1, "...")], items) == []
    same = [(1, "alpha beta")] * 15 + [(2, "beta gamma delta")] * 15
    got = run(spark, same, [(9, "alpha"), (9, "alpha"), (9, "beta")])  # of one id's texts the first in order
    assert [(r[1], r[2]) for r in sorted(got, key=lambda r: r[1])] == [(i + 1, 1) for i in range(10)]


def test_best_positions_stop_no_later_than_last_read():
    """Best positions lie at or beyond what was read, the bound is theirs, and reading stops before the lists end."""
    rng = np.random.default_rng(5)
    n, n_terms = 3000, 6
    held = [rng.permutation(n)[: n // (i + 1)] for i in range(n_terms)]
    docs, term = np.concatenate(held), np.repeat(np.arange(n_terms), [len(h) for h in held])
    tf, m = rng.zipf(1.7, len(docs)).clip(1, 50), rng.integers(25, 400, n)
    lists = search.Lists(docs, term, tf, m, n_terms)
    weight = np.array([1, 400, 900, 1300, 1600, 2000])
    trace = []
    got = lists.best(np.arange(n_terms), weight, 10, 0, np.arange(n), trace=trace)
    score = np.zeros(n, np.int64)
    np.add.at(score, docs, weight[term] * search.impact(tf, m[docs]))
    order = np.lexsort((np.arange(n), -score))[:10]
    assert got == [(int(score[d]), int(d)) for d in order]
    size = lists.start[1:] - lists.start[:-1]
    for depth, best, bound, kth in trace:
        assert (best >= np.minimum(depth, size)).all()
        last = sum(int(lists.f[lists.start[i] + min(depth, size[i]) - 1]) * int(weight[i]) for i in range(n_terms) if depth < size[i])
        assert bound <= last
    assert all(bound >= kth for *_, bound, kth in trace[:-1]) and trace[-1][2] < trace[-1][3] and trace[-1][0] < n
    floor = got[4][0]
    assert lists.best(np.arange(n_terms), weight, 10, floor, np.arange(n)) == [x for x in got if x[0] >= floor]


def test_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = catalogue.op12_ranked_search(spark, "/root/testdata/sf0.001")
    rel = con.sql(catalogue.oracle_sql()["op12_ranked_search"])
    rows = sorted(map(tuple, got.collect()))
    assert rows and rows == sorted(rel.select(*got.columns).fetchall())
