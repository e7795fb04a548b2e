"""Tree measures against walks in Python."""

import random

import pytest

from varloom.operators import trees


def forest_of(rng, sizes):
    rows = []
    for t, n in enumerate(sizes):
        names = rng.sample(range(10 * n), n)
        shape = rng.choice(["any", "path", "star", "deep"])
        for i, v in enumerate(names):
            up = None if i == 0 else names[{"any": rng.randrange(i), "path": i - 1, "star": 0, "deep": max(0, i - 1 - rng.randrange(3))}[shape]]
            rows.append((f"t{t}", v, up))
    return rows


class Plain:
    def __init__(self, rows):
        self.up = {(t, v): p for t, v, p in rows}
        self.kids = {}
        for t, v, p in rows:
            self.kids.setdefault((t, p), []).append(v)
        self.tour, self.depth, self.pre, self.post, self.size = {}, {}, {}, {}, {}
        for t in {t for t, _, _ in rows}:
            root = self.kids[t, None][0]
            self.tour[t], left = [], 0
            todo = [(root, 0, False)]
            while todo:
                v, d, done = todo.pop()
                self.tour[t].append((v, not done, d))
                if done:
                    self.post[t, v] = left
                    left += 1
                    self.size[t, v] = 1 + sum(self.size[t, c] for c in self.kids.get((t, v), []))
                    continue
                self.depth[t, v] = d
                self.pre[t, v] = sum(k[0] == t for k in self.pre)
                todo.append((v, d, True))
                todo += [(c, d + 1, False) for c in sorted(self.kids.get((t, v), []), reverse=True)]

    def above(self, t, v):
        out = [v]
        while self.up[t, out[-1]] is not None:
            out.append(self.up[t, out[-1]])
        return out


@pytest.fixture(scope="module")
def woods(spark):
    rng = random.Random(11)
    rows = forest_of(rng, [1, 2, 3, 7, 16, 33, 60, 60, 64])
    plain = Plain(rows)
    forest = spark.createDataFrame(rows, "tree string, v long, parent long")
    euler = trees.tour(forest)
    return rng, rows, plain, euler, trees.measures(euler)


def test_tour_and_measures(woods):
    _, rows, plain, euler, meta = woods
    got = {}
    for r in euler.orderBy("tree", "pos").collect():
        got.setdefault(r.tree, []).append((r.pos, r.v, r.down, r.depth))
    assert {t: [x[1:] for x in g] for t, g in got.items()} == plain.tour
    assert all([x[0] for x in g] == list(range(len(g))) for g in got.values())
    m = {(r.tree, r.v): (r.parent, r.depth, r.pre, r.post, r.size) for r in meta.collect()}
    assert m == {(t, v): (p, plain.depth[t, v], plain.pre[t, v], plain.post[t, v], plain.size[t, v]) for t, v, p in rows}


def test_lowest_common(spark, woods):
    rng, rows, plain, _, meta = woods
    of = {}
    for t, v, _ in rows:
        of.setdefault(t, []).append(v)
    pairs = [(t, rng.choice(vs), rng.choice(vs), i) for i, (t, vs) in enumerate(sorted(of.items()) * 60)]
    got = trees.lowest_common(spark.createDataFrame(pairs, "tree string, a long, b long, i int"), meta, trees.range_minima(meta)).collect()
    assert len(got) == len(pairs)
    for r in got:
        above = set(plain.above(r.tree, r.a))
        assert r.lca == next(v for v in plain.above(r.tree, r.b) if v in above)


def test_reach(spark, woods):
    rng, rows, plain, _, meta = woods
    back = []
    for t, v, _ in rows:
        over = plain.above(t, v)
        if len(over) > 1 and rng.random() < 0.6:
            back.append((t, v, rng.choice(over[1:])))
    got = {(r.tree, r.v): (r.lo, r.hid) for r in trees.reach(meta, spark.createDataFrame(back, "tree string, src long, tgt long")).collect()}
    assert len(got) == len(rows)
    for t, v, _ in rows:
        own = [(s, g) for u, s, g in back if u == t and plain.pre[t, g] < plain.pre[t, v] < plain.pre[t, s]]
        assert all(g in plain.above(t, v) for _, g in own)
        lo = max((g for _, g in own), key=lambda g: plain.depth[t, g], default=None)
        hid = min((s for s, _ in own), key=lambda s: (plain.depth[t, s], plain.pre[t, s]), default=None)
        assert got[t, v] == (lo, hid)


def test_no_trees(spark):
    empty = spark.createDataFrame([], "tree string, v long, parent long")
    meta = trees.measures(trees.tour(empty))
    assert meta.collect() == []
    assert trees.lowest_common(spark.createDataFrame([], "tree string, a long, b long"), meta, trees.range_minima(meta)).collect() == []
    assert trees.reach(meta, spark.createDataFrame([], "tree string, src long, tgt long")).collect() == []
