"""Finer kinds of bubbles below generic ones: concealed, midi and smothered, and the bubble tree that holds them.

A bubble stands between its inner ends a (upper) and z (lower) of its component's depth-first tree; the way from a to z is
its trunk, what hangs below z beside the way on are its branches. A concealed bubble joins an end with a place of the trunk
(ai_trunk, zi_trunk) or of a branch (ai_branch, zi_branch). Two concealed ones of the trunk, or of one branch, of which
one leaves from a and one from z, hold a midi bubble between their places. Smothered ones lie at the place of a concealed one.

Vertices are numbered in preorder, so a subtree is a range of numbers. An arc is a back edge, from below (src) to above
(tgt); one of the graph's own, or one that the classes added. Brackets of v are the graph's own arcs from strictly below
v to strictly above it. What the rules ask of brackets (their number, the deepest target, the shallowest source, the first
and last source) is kept per vertex or found in logarithmic time, never by walking a subtree.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame

from .decompose import _Families, _per_component, class_stack, cycle_classes, turned

NODES = "comp_id long, idx long, sym string, label string, parent_idx long, route string, kind string, i long, j long"


class Arcs:
    """Places, measures and arcs of one tree."""

    def __init__(self, tree: dict):
        self.side, self.parent, self.black, self.high = tree["side"], tree["parent"], tree["black"], tree["high"]
        n = self.n = len(self.parent)
        self.depth, self.size, self.children = [0] * n, [1] * n, [[] for _ in range(n)]
        for v in range(1, n):
            self.depth[v] = self.depth[self.parent[v]] + 1
            self.children[self.parent[v]].append(v)
        for v in range(n - 1, 0, -1):
            self.size[self.parent[v]] += self.size[v]
        self.out: list[list[tuple[int, bool]]] = [[] for _ in range(n)]
        self.into: list[list[tuple[int, bool]]] = [[] for _ in range(n)]
        for a, b, own in [*((max(a, b), min(a, b), True) for _, a, b in tree["back"]), *((a, b, False) for a, b in tree["added"])]:
            self.out[a].append((b, own))
            self.into[b].append((a, own))
        self._branching()
        self._brackets()
        self._minima()

    def below(self, a: int, d: int) -> bool:
        """Whether d stands strictly below a."""
        return a < d < a + self.size[a]

    def _branching(self) -> None:
        self.fork = [-1] * self.n  # the nearest vertex upwards, itself included, with two children or more
        for v in range(self.n):
            self.fork[v] = v if len(self.children[v]) > 1 else self.fork[self.parent[v]] if v else -1

    def _brackets(self) -> None:
        """count, deepest target, shallowest source's depth and sum of arc numbers of each vertex's brackets; lo.

        Children's heaps are poured into the larger one, so an arc moves a logarithmic number of times.
        """
        n, none = self.n, -1
        self.count, self.deep, self.shallow, self.numbers = [0] * n, [none] * n, [none] * n, [0] * n
        self.lo = [none] * n
        heaps: list[list | None] = [None] * n
        passing: list[int] = []
        self.arcs = [(a, b) for a in range(n) for b, own in self.out[a] if own]
        number = 0
        of = [0] * (n + 1)
        for a in range(n):
            of[a] = number
            number += sum(own for _, own in self.out[a])
        for v in range(n - 1, -1, -1):
            while passing and -passing[0] >= v:
                heapq.heappop(passing)
            if passing:
                self.lo[v] = -passing[0]
            for b, own in self.out[v]:
                if own:
                    heapq.heappush(passing, -b)
            tops: list = [[], []]
            for c in self.children[v]:
                more = heaps[c]
                heaps[c] = None
                for k in (0, 1):
                    if len(more[k]) > len(tops[k]):
                        tops[k], more[k] = more[k], tops[k]
                    for x in more[k]:
                        heapq.heappush(tops[k], x)
            by_target, by_source = tops
            while by_target and -by_target[0] >= v:
                heapq.heappop(by_target)
            while by_source and by_source[0][1] >= v:
                heapq.heappop(by_source)
            if v:
                self.deep[v] = -by_target[0] if by_target else none
                self.shallow[v] = by_source[0][0] if by_source else none
            for b, own in self.out[v]:
                if own and b < v:
                    heapq.heappush(by_target, -b)
                    heapq.heappush(by_source, (self.depth[v], b))
            heaps[v] = tops
        for k, (a, b) in enumerate(self.arcs):
            if a and a != b:
                self.count[self.parent[a]] += 1
                self.count[b] -= 1
                self.numbers[self.parent[a]] += k
                self.numbers[b] -= k
        for v in range(n - 1, 0, -1):
            self.count[self.parent[v]] += self.count[v]
            self.numbers[self.parent[v]] += self.numbers[v]
        if n:
            self.count[0] = 0  # nothing stands above the root

    def _minima(self) -> None:
        """Tables for lowest common ancestors, and for sources whose highest target is above a vertex."""
        depth = np.array(self.depth, np.int64)
        self._shallowest = [np.arange(self.n)]
        while 2 ** len(self._shallowest) <= self.n:
            last, step = self._shallowest[-1], 2 ** (len(self._shallowest) - 1)
            a, b = last[:-step], last[step:]
            self._shallowest.append(np.where(depth[a] <= depth[b], a, b))
        top = np.array([min((b for b, own in o if own), default=self.n) for o in self.out] or [0], np.int64)
        self._tops = [top]
        while len(self._tops[-1]) > 1:
            t = self._tops[-1]
            t = np.append(t, self.n) if len(t) % 2 else t
            self._tops[-1] = t
            self._tops.append(np.minimum(t[::2], t[1::2]))

    def common(self, a: int, b: int) -> int:
        """The lowest vertex that holds both."""
        a, b = min(a, b), max(a, b)
        if b < a + self.size[a]:
            return a
        k = (b - a).bit_length() - 1
        x, y = self._shallowest[k][a + 1], self._shallowest[k][b - 2**k + 1]
        return self.parent[int(x if self.depth[x] <= self.depth[y] else y)]

    def _first(self, lo: int, hi: int, v: int, last: bool) -> int:
        """The first (or last) vertex from lo to hi with an own arc to above v, -1 for none."""
        todo = [(len(self._tops) - 1, 0)]
        while todo:
            k, i = todo.pop()
            if i >= len(self._tops[k]) or i << k > hi or ((i + 1) << k) - 1 < lo or self._tops[k][i] >= v:
                continue
            if k == 0:
                return i
            todo += [(k - 1, 2 * i), (k - 1, 2 * i + 1)] if last else [(k - 1, 2 * i + 1), (k - 1, 2 * i)]
        return -1

    def sources(self, v: int) -> tuple[int, int]:
        """The first and the last source of v's brackets, of which it has some."""
        lo, hi = v + 1, v + self.size[v] - 1
        return self._first(lo, hi, v, False), self._first(lo, hi, v, True)

    def way(self, v: int) -> str:
        """The strand on which the tree leaves v's segment at v's side."""
        return ">" if self.side[v][1] == "r" else "<"


def _turn(way: str) -> str:
    return "<" if way == ">" else ">"


class _Bubble:
    """A node of the bubble tree."""

    __slots__ = ("sym", "label", "up", "route", "kind", "i", "j", "upper", "lower", "place", "edge", "held")

    def __init__(self, sym, label, route, kind=None, i=None, j=None, upper=-1, lower=-1, place=-1, edge=""):
        self.sym, self.label, self.route, self.kind, self.i, self.j = sym, label, route, kind, i, j
        self.upper, self.lower, self.place, self.edge = upper, lower, place, edge
        self.up: _Bubble | None = None
        self.held: list[_Bubble] = []

    def move(self, to: _Bubble) -> None:
        if self.up is not None:
            self.up.held.remove(self)
        self.up = to
        to.held.append(self)


def trunk_ends(t: Arcs, a: int, z: int) -> tuple[int, int]:
    """(m, n): the deepest place of the trunk, above z, that arcs into a leave; the deepest that arcs from z reach, else z."""
    m = max((p for p in (t.common(s, z) for s, own in t.into[a] if own) if t.depth[p] < t.depth[z]), key=lambda p: t.depth[p], default=a)
    n = max((b for b, own in t.out[z] if own), key=lambda b: t.depth[b], default=z)
    return m if t.depth[m] else a, n if t.depth[n] > t.depth[a] else z


def may_hold(t: Arcs, a: int, z: int, m: int, n: int) -> bool:
    """Whether concealed bubbles can be between the ends: arcs past z end at a or deeper, and something leaves the plain way."""
    if t.lo[z] < 0 or t.depth[t.lo[z]] < t.depth[a]:
        return False
    arcs_a = sum(own and s != z for s, own in t.into[a])
    arcs_z = sum(own for _, own in t.into[z])
    return m != a or n != z or arcs_a >= 2 or arcs_z > 0 or len(t.children[z]) >= 3


def _ai_places(t: Arcs, a: int, z: int, m: int, n: int) -> list[tuple[str, int, int]]:
    """(kind, place, source) of what end a conceals."""
    found = []
    if t.depth[m] <= t.depth[n]:
        fit = []
        for k, (s, own) in enumerate(t.into[a]):
            p = t.common(s, z)
            if not own or t.depth[p] > t.depth[m]:
                continue
            closed = t.deep[p] < 0 or t.depth[t.deep[p]] <= t.depth[a]  # all brackets of the place end at a or above
            if closed or (not t.out[p] and len(t.children[p]) < 2):
                fit.append((p, k, s))
        if fit:
            p, _, s = max(fit)
            found.append(("ai_trunk", p, s))
    if len(t.children[z]) > 1:
        for c in t.children[z]:
            if t.high[c] == t.lo[c] == a and t.count[c] > 1:
                p = t.common(*t.sources(c))
                if t.count[p] > 0:
                    found.append(("ai_branch", p, -1))
    return found


def _zi_places(t: Arcs, a: int, z: int, m: int, n: int) -> list[tuple[str, int, int]]:
    """(kind, place, source) of what end z conceals."""
    found = []
    depth = t.depth
    if depth[m] <= depth[n]:
        best = n
        for c in t.children[z]:
            if depth[t.high[c]] < depth[a] or t.count[c] != 1:
                continue
            g = t.arcs[t.numbers[c]][1]
            whole = t.count[g] == 0 or (t.shallow[g] >= depth[z] and depth[t.deep[g]] <= depth[a])
            if depth[m] < depth[g] < depth[n] and whole and depth[g] < depth[best]:
                best = g
        if best != z:
            found.append(("zi_trunk", best, -1))
    if len(t.children[z]) > 1 and z != n:
        straight = any(own and s == z for s, own in t.into[a])
        near, far = [], []
        for c in t.children[z]:
            back = [s for s, own in t.into[z] if own and t.below(c, s)]
            if t.count[c] - len(back) != 1:
                continue
            if back:
                near.append(("zi_branch", max(back, key=lambda s: depth[s]), -1))
                continue
            s, g = t.arcs[t.numbers[c]]
            if t.below(z, t.fork[s]) and t.count[g] == 1 and not straight:
                far.append(("zi_branch", t.fork[s], -1))
        found += near + far
    return found


def _concealed(t: Arcs, b: _Bubble, kind: str, p: int, s: int) -> _Bubble:
    way = t.way(p) if t.black[p] else _turn(t.way(p))
    if kind == "ai_branch":
        way = _turn(way)
    from_a = kind.startswith("ai")
    end = b.upper if from_a else b.lower
    seg, far = t.side[end][0], t.side[p][0]
    own = t.way(end) if from_a else _turn(t.way(end))
    both = way == own == "<"
    if from_a:
        outer, inner = (f">{far}", f">{seg}") if both else (f"{own}{seg}", f"{way}{far}")
        if kind == "ai_trunk":
            upper, lower = (end, s) if t.below(end, s) else (s, end)
        else:
            upper, lower = p, -1
        return _Bubble("C", outer + inner, "R", kind, b.i, b.j, upper, lower, p, inner)
    inner, outer = (f">{far}", f">{seg}") if both else (f"{way}{far}", f"{own}{seg}")
    upper, lower = (end, p) if t.below(end, p) else (p, end)
    return _Bubble("C", inner + outer, "L", kind, b.i, b.j, upper, lower, p, inner)


def _nest_concealed(t: Arcs, b: _Bubble, new: _Bubble, n: int) -> None:
    """Bubbles of b between an end and the trunk's place go below the concealed one; those at branches stay."""
    for c in list(b.held):
        if c.sym not in "FTO":
            continue
        if new.kind == "ai_trunk":
            inside = t.depth[new.place] > t.depth[c.lower] or t.below(new.place, c.upper)
        elif new.kind == "zi_trunk":
            inside = t.below(n, c.upper) and not t.below(b.lower, c.lower)
        else:
            inside = False
        if inside:
            c.move(new)


def _midi(t: Arcs, b: _Bubble) -> list[_Bubble]:
    """Midi bubbles of b, one for the trunk and one for each branch with just two concealed ones, one from either end."""
    groups: dict[int, list[_Bubble]] = {}
    for c in (x for x in b.held if x.sym == "C"):
        if c.place < b.lower:
            groups.setdefault(-1, []).append(c)
        else:
            for child in t.children[b.lower]:
                if not t.black[child] and t.below(child, c.place):
                    groups.setdefault(child, []).append(c)
    made = []
    for key in sorted(groups):
        pair = groups[key]
        g, s = [x for x in pair if x.kind.startswith("ai")], [x for x in pair if x.kind.startswith("zi")]
        if len(pair) == 2 and len(g) == 1:
            upper, lower = sorted((g[0].place, s[0].place))
            made.append(_Bubble("M", g[0].edge + s[0].edge, "L", "midi", b.i, b.j, upper, lower))
    return made


def _smothered(t: Arcs, c: _Bubble, a: int, z: int) -> list[_Bubble]:
    """Smothered bubbles at the place of a concealed one of a bubble with ends a and z."""
    p, made = c.place, []

    def add(v: int, above: bool, upper: int, lower: int) -> None:
        if t.side[v] is None:
            return
        far = t.way(v) + str(t.side[v][0])
        label = c.edge + far if c.kind.startswith("ai") and above else far + c.edge
        made.append(_Bubble("S", label, "L" if c.kind.startswith("ai") else "R", c.kind, c.i, c.j, upper, lower, v))

    def around(v: int) -> tuple[int, int]:
        return (p, v) if t.below(p, v) else (v, p)

    if c.kind == "ai_trunk":
        for child in t.children[p]:
            if t.count[child] == 0:
                continue
            s, last = t.sources(child)
            g = [b for b, own in t.out[s] if own and b < child][-1]
            if s == last and t.depth[g] > t.depth[a]:
                above = t.count[s] > 0
                add(s if above else g, above, t.common(z, s), s)
    elif c.kind == "ai_branch":
        if {b for b, _ in t.out[p]} == {a}:
            for s, own in t.into[a]:
                if own and t.below(p, s) and any(o and t.below(s, x) for x, o in t.into[p]):
                    add(s, True, *around(s))
    elif c.kind == "zi_trunk":
        at: dict[int, list[int]] = {}
        for s in sorted({s for s, _ in t.into[p]}):
            if t.depth[s] < t.depth[z] and (x := t.common(z, s)) != s:
                at.setdefault(x, []).append(s)
        for x in sorted(at):
            if len(at[x]) == 1:
                add(at[x][0], False, x, at[x][0])
    else:
        for s in sorted({s for s, _ in t.into[p]}):
            for x in sorted({x for x, _ in t.into[s]}):
                add(x, True, *((x, p) if t.below(x, p) else (p, x)))
            for x in sorted({x for x, _ in t.out[s]}):
                if x != z:
                    add(x, False, *((x, p) if t.below(x, p) else (p, x)))
    return made


def _chain_label(rows: list[tuple[str, int, int, int]], i: int, j: int) -> str:
    (a, s, *_), (b, e, *_) = rows[i], rows[j]
    return f">{e}>{s}" if a == b == "<" else f"{a}{s}{b}{e}"


def bubble_forest(tree: dict) -> list[_Bubble]:
    """All bubbles of a component in the order of their numbers: plain ones by start, then concealed, midi, smothered."""
    klass, _ = cycle_classes(tree)
    rows = class_stack(tree, klass)
    t = Arcs(tree)
    seen: set[tuple[int, int]] = set()
    plain: list[_Bubble] = []
    open_: list[_Bubble] = []
    for i, j, sym, upper, lower in _Families(tree).of(rows):
        pair = tuple(sorted((rows[i][1], rows[j][1])))
        if pair in seen:
            continue
        seen.add(pair)
        b = _Bubble(sym, _chain_label(rows, i, j), "L", None, i, j, upper, lower)
        while open_ and open_[-1].j < j:
            open_.pop()
        if open_:
            b.move(open_[-1])
        open_.append(b)
        plain.append(b)
    concealed: list[tuple[_Bubble, _Bubble]] = []
    found = []
    for b in plain:
        if b.sym != "F":
            continue
        m, n = trunk_ends(t, b.upper, b.lower)
        if may_hold(t, b.upper, b.lower, m, n):
            found.append((b, n, _ai_places(t, b.upper, b.lower, m, n) + _zi_places(t, b.upper, b.lower, m, n)))
    for b, n, places in found:
        for kind, p, s in places:
            new = _concealed(t, b, kind, p, s)
            new.move(b)
            _nest_concealed(t, b, new, n)
            concealed.append((b, new))
    midis = []
    for b in plain:
        if b.sym == "F":
            inner = list(b.held)
            for new in _midi(t, b):
                new.move(b)
                midis.append(new)
                for c in inner:
                    if c.sym == "F" and c.up is b and t.depth[new.upper] < t.depth[c.upper] and t.depth[new.lower] > t.depth[c.lower]:
                        c.move(new)
    smothered = []
    for b, c in concealed:
        for new in _smothered(t, c, b.upper, b.lower):
            new.move(c)
            smothered.append(new)
            for x in list(c.held):
                if x.sym in "FTO" and t.below(new.upper, x.upper) and t.below(x.lower, new.lower):
                    x.move(new)
    return [*plain, *(c for _, c in concealed), *midis, *smothered]


def _rows(tree: dict) -> list[tuple]:
    every = bubble_forest(tree)
    idx = {id(b): k + 1 for k, b in enumerate(every)}
    return [(idx[id(b)], b.sym, b.label, idx[id(b.up)] if b.up else 0, b.route, b.kind, b.i, b.j) for b in every]


def bubble_nodes(links: DataFrame, comps: DataFrame, min_vertices: int = 3) -> DataFrame:
    """(comp_id, idx, sym, label, parent_idx, route, kind, i, j): the bubble tree of every component with all kinds.

    Bubbles are numbered from 1, plain ones (F, T tiny, O parallel) by their start, then C concealed, M midi and S
    smothered ones; the root is 0 and has no row. route is L from the first boundary to the second, else R. kind tells where
    a concealed bubble lies and which one a smothered one belongs to; i and j are the plain bubble's places on the class stack.
    """
    return _per_component(links, comps, min_vertices, turned(_rows, 8), NODES)
