"""Concealed, midi and smothered bubbles against the rules told with whole sets of arcs and walks to the root."""

import random

import pytest

from varloom.operators import decompose, subbubbles
from varloom.plans.graph_api import Graph


def random_graph(rng, n):
    """A chain with local links of all kinds, now and then with gaps."""
    links = {(v, "r", v + 1, "l") for v in range(n - 1)}
    turns = rng.choice([0.3, 1.0])
    for _ in range(rng.randrange(1, max(2, n))):
        a = rng.randrange(n)
        b = min(n - 1, max(0, a + rng.randrange(-3, 5)))
        links.add((a, rng.choice("lr"), b, rng.choice("lr")) if rng.random() < turns else (min(a, b), "r", max(a, b), "l"))
    if turns == 1.0 and n > 3:
        for v in rng.sample(range(1, n - 1), rng.randrange(0, min(3, n - 2))):
            links.discard((v, "r", v + 1, "l"))
    return [(i, *e) for i, e in enumerate(sorted(links))]


class Walks:
    """A tree by walks to its root."""

    def __init__(self, tree):
        self.tree, self.parent, self.n = tree, tree["parent"], len(tree["parent"])
        self.own = sorted((max(a, b), k, min(a, b)) for k, (_, a, b) in enumerate(tree["back"]))
        self.own = [(a, b) for a, _, b in self.own]
        self.every = [(max(a, b), min(a, b)) for _, a, b in tree["back"]] + list(tree["added"])
        self.kids = {v: [c for c in range(self.n) if self.parent[c] == v] for v in range(self.n)}

    def up(self, v):
        out = [v]
        while self.parent[out[-1]] >= 0:
            out.append(self.parent[out[-1]])
        return out

    def depth(self, v):
        return len(self.up(v)) - 1

    def lca(self, vs):
        common = set.intersection(*(set(self.up(v)) for v in vs))
        return max(common, key=self.depth)

    def below(self, a, d):
        return a != d and a in self.up(d)

    def brackets(self, v):
        return [(s, g) for s, g in self.own if v and self.below(v, s) and self.below(g, v)]

    def lo(self, v):
        return max((g for s, g in self.own if g < v < s), key=self.depth, default=None)

    def way(self, v):
        return ">" if self.tree["side"][v][1] == "r" else "<"


def turn(x):
    return "<" if x == ">" else ">"


def concealed_places(t, a, z):
    at = [s for s, g in t.own if g == a]
    m = max((p for p in (t.lca([s, z]) for s in at) if t.depth(p) < t.depth(z) and t.depth(p)), key=t.depth, default=a)
    from_z = [g for s, g in t.own if s == z]
    n = max((g for g in from_z if t.depth(g) > t.depth(a)), key=t.depth, default=z)
    lo = t.lo(z)
    if lo is None or t.depth(lo) < t.depth(a):
        return m, n, []
    if m == a and n == z and sum(s != z for s in at) < 2 and not any(g == z for _, g in t.own) and len(t.kids[z]) < 3:
        return m, n, []
    out = []
    if t.depth(m) <= t.depth(n):
        fit = []
        for s in at:
            p = t.lca([s, z])
            if t.depth(p) <= t.depth(m):
                ends_above = all(t.depth(g) <= t.depth(a) for _, g in t.brackets(p))
                if ends_above or not (any(x == p for x, _ in t.every) or len(t.kids[p]) > 1):
                    fit.append(p)
        if fit:
            out.append(("ai_trunk", max(fit)))
    if len(t.kids[z]) >= 2:
        for c in t.kids[z]:
            br = t.brackets(c)
            if t.tree["high"][c] == t.lo(c) == a and len(br) > 1:
                d = t.lca([s for s, _ in br])
                if t.brackets(d):
                    out.append(("ai_branch", d))
    if t.depth(m) <= t.depth(n):
        held = []
        for c in t.kids[z]:
            br = t.brackets(c)
            if t.depth(t.tree["high"][c]) >= t.depth(a) and len(br) == 1:
                g = br[0][1]
                if t.depth(m) < t.depth(g) < t.depth(n) and all(t.depth(s) >= t.depth(z) and t.depth(x) <= t.depth(a) for s, x in t.brackets(g)):
                    held.append(g)
        if held:
            out.append(("zi_trunk", min(held, key=t.depth)))
        elif n != z:
            out.append(("zi_trunk", n))
    if len(t.kids[z]) >= 2 and n != z:
        late = []
        for c in t.kids[z]:
            br = t.brackets(c)
            past, here = [x for x in br if x[1] != z], [x for x in br if x[1] == z]
            if len(past) == 1 and here:
                out.append(("zi_branch", max((s for s, _ in here), key=t.depth)))
            elif len(past) == 1:
                s, g = past[0]
                forks = [v for v in t.up(s) if t.below(z, v) and len(t.kids[v]) > 1]
                if forks and len(t.brackets(g)) == 1 and not (z, a) in t.own:
                    late.append(("zi_branch", forks[0]))
        out += late
    return m, n, out


def labels_of(t, a, z, kind, p):
    way = t.way(p) if t.tree["black"][p] else turn(t.way(p))
    seg = lambda v: t.tree["side"][v][0]
    if kind.startswith("ai"):
        if kind == "ai_branch":
            way = turn(way)
        if way == t.way(a) == "<":
            return f">{seg(p)}>{seg(a)}", f">{seg(a)}"
        return f"{t.way(a)}{seg(a)}{way}{seg(p)}", f"{way}{seg(p)}"
    end = turn(t.way(z))
    if way == end == "<":
        way = end = ">"
    return f"{way}{seg(p)}{end}{seg(z)}", f"{way}{seg(p)}"


def smothered_places(t, kind, p, a, z):
    """(vertex, whether the concealed place is above it) of each."""
    out = []
    if kind == "ai_trunk":
        for c in t.kids[p]:
            br = t.brackets(c)
            if br and len({s for s, _ in br}) == 1:
                s, g = br[-1]
                if t.depth(g) > t.depth(a):
                    out.append((s, True) if t.brackets(s) else (g, False))
    elif kind == "ai_branch":
        if {g for s, g in t.every if s == p} == {a}:
            out += [(s, True) for s, g in t.brackets(p) if g == a and any(x == p for _, x in t.brackets(s))]
    elif kind == "zi_trunk":
        srcs = {s for s, g in t.every if g == p and t.depth(s) < t.depth(z) and t.lca([s, z]) != s}
        out += [(s, False) for s in srcs if sum(t.lca([x, z]) == t.lca([s, z]) for x in srcs) == 1]
    else:
        for s in {s for s, g in t.every if g == p}:
            out += [(x, True) for x in {x for x, g in t.every if g == s}]
            out += [(x, False) for x in {g for x, g in t.every if x == s} if x != z]
    return [(v, above) for v, above in out if t.tree["side"][v]]


def plain_nodes(tree):
    """Labels of the finer bubbles, each with its bubble's label: sorted (sym, label, kind)."""
    klass, _ = decompose.cycle_classes(tree)
    rows = decompose.class_stack(tree, klass)
    t = Walks(tree)
    out, seen = [], set()
    for i, j, sym, a, z in decompose._Families(tree).of(rows):
        pair = frozenset((rows[i][1], rows[j][1]))
        if pair in seen or sym != "F":
            seen.add(pair)
            continue
        seen.add(pair)
        _, _, places = concealed_places(t, a, z)
        told = [(kind, p, *labels_of(t, a, z, kind, p)) for kind, p in places]
        out += [("C", label, kind) for kind, _, label, _ in told]
        groups = {}
        for kind, p, _, edge in told:
            where = -1 if p < z else next((c for c in t.kids[z] if not tree["black"][c] and t.below(c, p)), None)
            if where is not None:
                groups.setdefault(where, []).append((kind, edge))
        for pair in groups.values():
            if len(pair) == 2 and len({k[:2] for k, _ in pair}) == 2:
                g, s = sorted(pair)
                out.append(("M", g[1] + s[1], "midi"))
        for kind, p, _, edge in told:
            for v, above in smothered_places(t, kind, p, a, z):
                far = f"{t.way(v)}{tree['side'][v][0]}"
                out.append(("S", edge + far if kind.startswith("ai") and above else far + edge, kind))
    return sorted(out)


def forest(links, n):
    return subbubbles.bubble_forest(decompose.spanning_tree(range(n), links))


@pytest.mark.parametrize("seed", range(4))
def test_kinds_are_the_rules(seed):
    rng = random.Random(seed)
    found = 0
    for _ in range(2500):
        n = rng.randrange(4, 16)
        links = random_graph(rng, n)
        tree = decompose.spanning_tree(range(n), links)
        got = sorted((b.sym, b.label, b.kind) for b in subbubbles.bubble_forest(tree) if b.sym in "CMS")
        assert got == plain_nodes(tree), links
        found += len(got)
    assert found > 20


def test_values_of_the_queries_are_those_of_walks():
    from varloom.plans.structures import BUBBLES, TREES
    from varloom.plans.synth import GADGETS

    assert {kind for *_, kind in BUBBLES} == {"-", "ai_trunk", "ai_branch", "zi_trunk", "zi_branch", "midi"}
    for g, links in enumerate(GADGETS):
        vs = sorted({x for e in links for x in (e[0], e[2])})
        tree = decompose.spanning_tree(vs, [(i, *e) for i, e in enumerate(links)])
        decompose.cycle_classes(tree)
        t = Walks(tree)
        sides = [v for v in range(t.n) if tree["side"][v]]
        under = lambda v: 1 + sum(t.below(v, x) for x in range(t.n))
        assert TREES[g] == (g, len(sides), max(map(under, sides)), max(map(t.depth, sides)), sum(len(t.brackets(v)) for v in sides))
        told = sorted((sym, f"{a}{x}{b}{y}", kind) for n, _, sym, a, x, b, y, _, _, kind in BUBBLES if n == g and sym in "CMS")
        assert told == plain_nodes(tree)


def test_measures_are_those_of_walks():
    rng = random.Random(9)
    for _ in range(150):
        n = rng.randrange(1, 25)
        tree = decompose.spanning_tree(range(n), random_graph(rng, n) if n > 1 else [])
        decompose.cycle_classes(tree)
        a, t = subbubbles.Arcs(tree), Walks(tree)
        for v in range(t.n):
            br = t.brackets(v)
            assert a.count[v] == len(br)
            assert (a.deep[v] if v else -1) == max((g for _, g in br), default=-1)
            assert (a.shallow[v] if v else -1) == min((t.depth(s) for s, _ in br), default=-1)
            assert a.lo[v] == (-1 if t.lo(v) is None else t.lo(v))
            if br:
                assert a.sources(v) == (min(br)[0], max(br)[0])
            if len(br) == 1:
                assert a.arcs[a.numbers[v]] == br[0]
        for _ in range(20):
            x, y = rng.randrange(t.n), rng.randrange(t.n)
            assert a.common(x, y) == t.lca([x, y])


def test_tree_of_all_kinds_is_a_tree():
    """Every bubble hangs once, below one that stands before it or the root, and plain bubbles stay in their bubble."""
    rng = random.Random(10)
    for _ in range(1500):
        n = rng.randrange(4, 20)
        every = forest(random_graph(rng, n), n)
        assert len({id(b) for b in every}) == len(every)
        assert sum(len(b.held) for b in every) == sum(b.up is not None for b in every)
        for b in every:
            way, up = [b], b.up
            while up:
                assert up not in way
                way.append(up)
                up = up.up
            if b.sym in "CM":
                assert b.up.sym == "F"
            if b.sym == "S":
                assert b.up.sym == "C" and b.up.kind == b.kind


def test_deep_tree_takes_little_time():
    import time

    n = 60_000
    links = [(i, i, "r", i + 1, "l") for i in range(n - 1)] + [(n + i, i, "r", i + 2, "l") for i in range(0, n - 2, 3)]
    tree = decompose.spanning_tree(range(n), links)
    t = time.perf_counter()
    assert len(subbubbles.bubble_forest(tree)) == len(range(0, n - 2, 3))
    assert time.perf_counter() - t < 20


def test_nodes_of_many_components(spark):
    # 0 to 4: a bubble whose upper end conceals a branch; the same again from 10 on
    gadget = [(0, "l", 0, "l"), (0, "r", 1, "l"), (0, "r", 3, "l"), (1, "r", 2, "l"), (1, "r", 3, "l"), (2, "r", 3, "l")]
    links = [(a + k, x, b + k, y) for k in (0, 10) for a, x, b, y in gadget]
    g = Graph.build(spark, [(v + k, "A") for k in (0, 10) for v in range(4)], links)
    got = sorted((r.comp_id, r.idx, r.sym, r.label, r.parent_idx, r.route) for r in g.bubbles().collect())
    assert got == [(1, 1, "F", ">0>3", 0, "L"), (1, 2, "C", ">1>3", 1, "R"), (2, 1, "F", ">10>13", 0, "L"), (2, 2, "C", ">11>13", 1, "R")]
    lines = [r.line for r in g.bubble_lines().where("comp_id = 1").orderBy("idx").collect()]
    assert lines == ["H\t0.0.3\t.\t.\t.", "D\t0\t.\t1\t.", "F\t1\t>0>3\t2\tL", "C\t2\t>1>3\t.\tR"]
