"""Decomposition of components into nested bubbles: spanning tree, cycle classes, boundaries, hierarchy.

The tree walk and the bracket lists are sequential within a component, so they run as one grouped-map kernel per
component; everything after the class stack is relational.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.durable import written
from .grouped import adjacency, by_key, filled, packed

STACK = "comp_id long, i long, orient string, seg_id long, tree_edge long, class_id long"


class _Sides:
    """The sides of tree vertices, (segment, l or r) or None for the dummy, kept as numbers."""

    __slots__ = ("seg", "of")

    def __init__(self, seg: array):
        self.seg, self.of = seg, array("q")

    def __len__(self) -> int:
        return len(self.of)

    def __getitem__(self, v: int) -> tuple[int, str] | None:
        s = self.of[v]
        return None if s < 0 else (self.seg[s >> 1], "r" if s & 1 else "l")


class _Backs:
    """Back edges (number, from, to), kept as numbers."""

    __slots__ = ("number", "a", "b")

    def __init__(self):
        self.number, self.a, self.b = array("q"), array("q"), array("q")

    def __len__(self) -> int:
        return len(self.a)

    def __iter__(self):
        return zip(self.number, self.a, self.b)


def spanning_tree(vertices: Iterable[int], links: Iterable[tuple[int, int, str, int, str]]) -> dict:
    """Depth-first tree over the sides of one component's segments.

    Entering a segment at a side adds that side (by a gray edge) and at once the opposite one (by a black edge). Links
    to visited sides become back edges, sides without links get a back edge to the root. With tips the root is a dummy
    above the smallest tip; tree and back edges share one numbering.
    """
    rows = [(i, a, ea == "r", b, eb == "r") for i, a, ea, b, eb in links]
    return _tree(np.array(list(vertices), np.int64), *np.array(rows, np.int64).reshape(-1, 5).T)


def _tree(vertices: np.ndarray, *links: np.ndarray) -> dict:
    """spanning_tree() of links (number, v1, end, v2, end) as columns, ends 0 left and 1 right."""
    order = np.unique(vertices)
    start, near, number = adjacency(order, *links)
    side, parent, edge_in, black, back = _Sides(packed(order)), array("q"), array("q"), bytearray(), _Backs()
    tree = {"side": side, "parent": parent, "edge": edge_in, "black": black, "back": back}
    if not len(order):
        return tree
    place = filled(2 * len(order), -1)
    apart: set[int] = set()  # vertices that a back edge joins, as lower * 2**32 + upper
    looped: set[int] = set()
    counter = 0
    none = np.diff(np.array(start)) == 0
    tip = none.copy()
    tip[1::2] &= ~none[::2]
    first = int(np.argmax(tip)) if tip.any() else -1

    def add(s: int, up: int, is_black: int) -> None:
        nonlocal counter
        if s >= 0:
            place[s] = len(parent)
        side.of.append(s)
        parent.append(up)
        black.append(is_black)
        edge_in.append(counter if up >= 0 else -1)
        counter += up >= 0

    def add_back(a: int, b: int) -> None:
        nonlocal counter
        back.number.append(counter)
        back.a.append(a)
        back.b.append(b)
        counter += 1
        apart.add((b << 32) + a if a < b else (a << 32) + b)

    if first >= 0:
        add(-1, -1, 0)
    add(max(first, 0), len(parent) - 1, 0)
    add(max(first, 0) ^ 1, len(parent) - 1, 1)
    stack = array("q", [len(parent) - 2, len(parent) - 1])
    at = start[:]
    while stack:
        v = stack[-1]
        s = side.of[v]
        k, end = at[s], start[s + 1]
        if k == end == start[s] and v and parent[v] and v << 32 not in apart:
            add_back(v, 0)
        new = -1
        while k < end:
            other = near[k]
            w = place[other]
            k += 1
            if w < 0:
                new = other
                break
            if other >> 1 == s >> 1:
                if other != s and number[k - 1] not in looped:
                    looped.add(number[k - 1])
                    add_back(max(v, w), min(v, w))
            else:
                hi, lo = (v, w) if v > w else (w, v)
                if parent[hi] != lo and (hi << 32) + lo not in apart:
                    add_back(v, w)
        at[s] = k
        if new < 0:
            stack.pop()
        else:
            add(new, v, 0)
            add(new ^ 1, len(parent) - 1, 1)
            stack.append(len(parent) - 2)
            stack.append(len(parent) - 1)
    return tree


def _kids(parent: array) -> tuple[array, array]:
    """(first child of each vertex, next child of the same parent), in the order of their numbers, -1 for none."""
    n = len(parent)
    first, following = filled(n, -1), filled(n, -1)
    for v in range(n - 1, 0, -1):
        following[v] = first[parent[v]]
        first[parent[v]] = v
    return first, following


def cycle_classes(tree: dict) -> tuple[array, list[tuple[int, int]]]:
    """(class of the edge above each tree vertex, hairpin boundaries as pairs of tree vertices).

    The brackets that it adds to the tree's own back edges are left in tree["added"] as (from, to), the highest vertex that
    the back edges of a vertex and of those below it reach in tree["high"].

    Vertices are taken in falling order of discovery. A vertex's bracket list joins its children's, loses the brackets
    that end here and gains those that start here, with a capping one where two children reach above it. The edge above
    has the class of the top bracket at its present size. Lists are doubly linked by numbers: push to the front, splice in
    front and removal take constant time.
    """
    parent, n = tree["parent"], len(tree["parent"])
    first, following = _kids(parent)
    a, b = np.array(tree["back"].a, np.int64), np.array(tree["back"].b, np.int64)
    low, top = np.maximum(a, b), np.minimum(a, b)
    by = np.argsort(low, kind="stable")
    by = by[low[by] != top[by]]
    begin, target = packed(np.concatenate(([0], np.cumsum(np.bincount(low[by], minlength=n))))), packed(top[by])
    head, tail, count, high = filled(n, -1), filled(n, -1), filled(n, 0), filled(n, n)
    ends = filled(n, -1)  # the last bracket that ends at a vertex
    before, after, size, kind, same_end = (array("q") for _ in range(5))
    klass = filled(n, -1)
    fresh = 0
    hairpins: list[tuple[int, int]] = []
    added = tree["added"] = []
    tree["high"] = high

    def push(v: int, to: int) -> None:
        new = len(before)
        before.append(-1)
        after.append(head[v])
        size.append(-1)
        kind.append(-1)
        same_end.append(ends[to])
        ends[to] = new
        if head[v] >= 0:
            before[head[v]] = new
        else:
            tail[v] = new
        head[v] = new
        count[v] += 1

    for v in range(n - 1, 0, -1):
        lo, hi = begin[v], begin[v + 1]
        own = min(target[lo:hi], default=n)
        one = two = n
        c = first[v]
        while c >= 0:
            h = high[c]
            if h < one:
                one, two = h, one
            elif h < two:
                two = h
            if count[c]:
                if count[v]:
                    after[tail[c]] = head[v]
                    before[head[v]] = tail[c]
                else:
                    tail[v] = tail[c]
                head[v] = head[c]
                count[v] += count[c]
            c = following[c]
        high[v] = min(own, one)
        x = ends[v]
        while x >= 0:
            p, q = before[x], after[x]
            if p >= 0:
                after[p] = q
            else:
                head[v] = q
            if q >= 0:
                before[q] = p
            else:
                tail[v] = p
            count[v] -= 1
            x = same_end[x]
        for k in range(lo, hi):
            push(v, target[k])
        if two < own and two < v:
            push(v, two)
            added.append((v, two))
        if not count[v]:
            push(v, 0)
            added.append((v, 0))
            high[v] = 0
            if tree["side"][v]:
                hairpins.append((v, parent[v]))
        x = head[v]
        if size[x] != count[v]:
            size[x], kind[x] = count[v], fresh
            fresh += 1
        klass[v] = kind[x]
    return klass, hairpins


def stack_columns(tree: dict, klass: array) -> tuple[list[str], array, array, array]:
    """class_stack() as columns."""
    parent, black, of, seg = tree["parent"], tree["black"], tree["side"].of, tree["side"].seg
    n = len(parent)
    first, following = _kids(parent)
    orient, ids, edges, classes = [], array("q"), array("q"), array("q")
    if n and black[0]:
        raise ValueError("a root has no edge")
    todo = [0] if n else []
    while todo:
        v = todo.pop()
        if black[v]:
            orient.append(">" if of[v] & 1 else "<")
            ids.append(seg[of[v] >> 1])
            edges.append(tree["edge"][v])
            classes.append(klass[v])
        kids, last = [], []
        c = first[v]
        while c >= 0:
            (last if black[c] else kids).append(c)
            c = following[c]
        last.reverse()
        kids.reverse()
        todo += last
        todo += kids
    return orient, ids, edges, classes


def class_stack(tree: dict, klass: array) -> list[tuple[str, int, int, int]]:
    """(orient, segment, tree edge, class) of the black edges in the tree's order, a vertex's black child after the others."""
    return list(zip(*stack_columns(tree, klass)))


def tree_measures(tree: dict) -> dict[str, list[int]]:
    """Per tree vertex: depth, size (of its subtree, itself included) and brackets (back edges from below it to above it)."""
    parent, n = tree["parent"], len(tree["parent"])
    depth, size, brackets = [0] * n, [1] * n, [0] * n
    for v in range(1, n):
        depth[v] = depth[parent[v]] + 1
    for _, a, b in tree["back"]:
        a, b = max(a, b), min(a, b)
        if a != b and a:
            brackets[parent[a]] += 1
            brackets[b] -= 1
    for v in range(n - 1, 0, -1):
        size[parent[v]] += size[v]
        brackets[parent[v]] += brackets[v]
    return {"depth": depth, "size": size, "brackets": brackets}


class _Families:
    """What kind of bubble a bubble without others in it is, told from the tree between its inner ends.

    upper and lower are the inner ends: of the four tree vertices of its two black edges the middle ones.
    """

    def __init__(self, tree: dict):
        self.tree = tree
        self.measures = tree_measures(tree)
        n = len(tree["parent"])
        self.children: list[list[int]] = [[] for _ in range(n)]
        for v in range(1, n):
            self.children[tree["parent"][v]].append(v)
        self.below = [-1] * (max(tree["edge"], default=-1) + 1)  # tree edge -> its lower vertex
        for v, e in enumerate(tree["edge"]):
            if e >= 0:
                self.below[e] = v
        # back edges by their ends: (other end, whether the graph has it)
        self.out: list[list[tuple[int, bool]]] = [[] for _ in range(n)]
        self.into: list[list[tuple[int, bool]]] = [[] for _ in range(n)]
        for a, b, own in [*((max(a, b), min(a, b), True) for _, a, b in tree["back"]), *((a, b, False) for a, b in tree["added"])]:
            self.out[a].append((b, own))
            self.into[b].append((a, own))

    def ends(self, edge_a: int, edge_b: int) -> tuple[int, int]:
        four = sorted(x for e in (edge_a, edge_b) for x in (self.below[e], self.tree["parent"][self.below[e]]))
        return four[1], four[2]

    def _gray(self, v: int) -> list[int]:
        return [c for c in self.children[v] if not self.tree["black"][c]]

    def tiny(self, upper: int, lower: int) -> bool:
        """A segment or none between the ends, and beside it only single segments that lead back to the upper end."""
        size = self.measures["size"]
        back = lambda c: size[c] == 2 and any(to == upper for to, own in self.out[self.children[c][0]] if own)
        return lower - upper in (1, 3) and all(back(c) for c in self._gray(lower))

    def parallel(self, upper: int, lower: int) -> bool:
        """Most of what lies between the ends is reached from one of them directly."""
        return self._parallel_branch(upper, lower) or self._parallel_trunk(upper, lower)

    def _parallel_branch(self, upper: int, lower: int) -> bool:
        gray = self._gray(lower)
        if lower - upper != 1 or len(gray) != 1:
            return False
        inside = self.measures["brackets"][gray[0]]
        need = inside + len(self.out[gray[0]])
        return inside > 2 and (sum(own for _, own in self.into[upper]) >= need or len(self.out[lower]) >= need)

    def _parallel_trunk(self, upper: int, lower: int) -> bool:
        span = lower - upper
        if span < 3 or (span == 3 and len(self.into[upper]) <= 1) or len(self.children[lower]) != 1:
            return False
        forks, v = [], lower
        while v != upper and v > 0:
            if len(self.children[v]) > 1:
                forks.append(v)
            v = self.tree["parent"][v]
        if len(forks) > 1 or (forks and not any(c > lower and self.measures["size"][c] == 2 for c in self.children[forks[0]])):
            return False
        at_upper = sum(own for _, own in self.into[upper])
        if 2 * at_upper >= span - 3:
            return True
        return at_upper == 0 and 2 * sum(own for _, own in self.out[lower]) >= span - 3

    def of(self, rows: list[tuple[str, int, int, int]]) -> list[tuple[int, int, str, int, int]]:
        """(i, j, symbol, upper, lower) of every bubble of class_stack() rows; symbols as in the tree's text form."""
        later: dict[int, int] = {}
        spans = []
        for i in range(len(rows) - 1, -1, -1):
            j = later.get(rows[i][3], i)
            later[rows[i][3]] = i
            if j > i + 1:
                spans.append((i, j))
        spans.sort(key=lambda s: (s[0], -s[1]))
        out = []
        for k, (i, j) in enumerate(spans):
            upper, lower = self.ends(rows[i][2], rows[j][2])
            leaf = k + 1 == len(spans) or spans[k + 1][1] > j
            symbol = "F" if not leaf else "T" if self.tiny(upper, lower) else "O" if self.parallel(upper, lower) else "F"
            out.append((i, j, symbol, upper, lower))
        return out


def _per_component(links: DataFrame, comps: DataFrame, min_vertices: int, columns_of, schema: str) -> DataFrame:
    """columns_of(tree) of every component of at least min_vertices segments, behind its comp_id."""
    zero = F.lit(0).cast("bigint")
    v = comps.select("comp_id", zero.alias("is_link"), F.col("seg_id").alias("edge_idx"), *[zero.alias(c) for c in ("v1", "e1", "v2", "e2")])
    width = len(schema.split(", ")) - 1

    def kernel(is_link, *rest):
        link = is_link == 1
        vertices = rest[0][~link]
        if len(vertices) < min_vertices:
            return [[]] * width
        return columns_of(_tree(vertices, *(x[link] for x in rest)))

    return by_key(v.unionByName(numbered_links(links, comps)), kernel, schema)


def numbered_links(links: DataFrame, comps: DataFrame) -> DataFrame:
    """(comp_id, is_link, edge_idx, v1, e1, v2, e2): links by component, as longs: ends 0 left and 1 right, is_link 1."""
    end = lambda c: F.expr(f"CAST({c} = 'r' AS BIGINT)")
    return _with_component(links, comps).select("comp_id", F.lit(1).cast("bigint").alias("is_link"), "edge_idx", "v1", end("v1_end").alias("e1"), "v2", end("v2_end").alias("e2"))


def turned(rows_of, width: int):
    """rows_of(tree) as columns."""
    return lambda tree: list(zip(*rows_of(tree))) or [[]] * width


def stacks_with_families(links: DataFrame, comps: DataFrame, min_vertices: int = 3) -> DataFrame:
    """class_stacks(), and at each bubble's start its end j, sym (T tiny, O parallel, else F) and inner ends in the tree."""

    def rows(tree: dict) -> list[tuple]:
        stack = class_stack(tree, cycle_classes(tree)[0])
        kind = {i: rest for i, *rest in _Families(tree).of(stack)}
        return [(i, *r, *kind.get(i, (None, None, None, None))) for i, r in enumerate(stack)]

    return _per_component(links, comps, min_vertices, turned(rows, 9), f"{STACK}, j long, sym string, upper long, lower long")


def families(stack: DataFrame) -> DataFrame:
    """(comp_id, i, j, sym, upper, lower) of every bubble of stacks_with_families()."""
    return stack.where("sym IS NOT NULL").select("comp_id", "i", "j", "sym", "upper", "lower")


def bracket_counts(links: DataFrame, comps: DataFrame) -> DataFrame:
    """(comp_id, seg_id, side, depth, size, brackets) of every side in its component's tree."""

    def rows(tree: dict) -> list[tuple]:
        m = tree_measures(tree)
        return [(*s, m["depth"][v], m["size"][v], m["brackets"][v]) for v, s in enumerate(tree["side"]) if s]

    return _per_component(links, comps, 1, turned(rows, 5), "comp_id long, seg_id long, side string, depth long, size long, brackets long")


def _with_component(links: DataFrame, comps: DataFrame) -> DataFrame:
    return links.join(comps.select(F.col("seg_id").alias("v1"), "comp_id"), "v1")


def class_stacks(links: DataFrame, comps: DataFrame, min_vertices: int = 3) -> DataFrame:
    """The class stack of every component of at least min_vertices segments: (comp_id, i, orient, seg_id, tree_edge, class_id)."""

    def columns(tree: dict) -> tuple:
        told = stack_columns(tree, cycle_classes(tree)[0])
        return range(len(told[0])), *told

    return _per_component(links, comps, min_vertices, columns, STACK)


def hairpins(links: DataFrame, comps: DataFrame) -> DataFrame:
    """(comp_id, seg_id, side): sides below which no cycle passes, where a hairpin may turn."""
    return _per_component(links, comps, 1, turned(lambda tree: [tree["side"][v] for v, _ in cycle_classes(tree)[1]], 2), "comp_id long, seg_id long, side string")


def next_seen(stack: DataFrame) -> DataFrame:
    """stack(comp_id, i, class_id, ...) with nxt: the next place of the same class, else the place itself."""
    w = Window.partitionBy("comp_id", "class_id").orderBy("i")
    return stack.withColumn("nxt", F.coalesce(F.lead("i").over(w), F.col("i")))


def boundaries(stack: DataFrame) -> DataFrame:
    """(comp_id, i, j, label, start_or, start_id, end_or, end_id): places closed by their class with something between.

    Where both ends are < the label is turned to > and its ends change places. Of places that join the same two
    segments, in whichever order, the first of a component counts.
    """
    s = next_seen(stack).where("nxt > i + 1")
    e = stack.select("comp_id", F.col("i").alias("nxt"), F.col("orient").alias("o2"), F.col("seg_id").alias("s2"))
    b = s.join(e, ["comp_id", "nxt"])
    turned = (F.col("orient") == "<") & (F.col("o2") == "<")
    pick = lambda a, b, name: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(name)
    b = b.select("comp_id", "i", F.col("nxt").alias("j"), F.when(turned, ">").otherwise(F.col("orient")).alias("start_or"), pick("seg_id", "s2", "start_id"), F.when(turned, ">").otherwise(F.col("o2")).alias("end_or"), pick("s2", "seg_id", "end_id"))
    pair = ["comp_id", F.least("start_id", "end_id").alias("_a"), F.greatest("start_id", "end_id").alias("_b")]
    b = b.groupBy(*pair).agg(F.min(F.struct("i", "j", "start_or", "start_id", "end_or", "end_id")).alias("x")).select("comp_id", "x.*")
    label = F.concat("start_or", F.col("start_id").cast("string"), "end_or", F.col("end_id").cast("string"))
    return b.select("comp_id", "i", "j", label.alias("label"), "start_or", "start_id", "end_or", "end_id")


def hierarchy(spans: DataFrame, key: str = "comp_id", lo: str = "i", hi: str = "j") -> DataFrame:
    """spans with parent_lo, parent_hi (the smallest span that strictly holds it, null at the top) and level (how many do).

    Spans are binned by powers of two: a span meets those that hold it in the bins of its own start at its own size and
    every larger, so the join is on equality and a row has as many bins as sizes exist, not as spans.
    """
    bin_of = lambda x, k: F.floor(F.col(x) / F.pow(F.lit(2.0), F.col(k) + 1)).cast("bigint")
    own = spans.withColumn("_k", F.floor(F.log2(F.greatest(F.lit(1), F.col(hi) - F.col(lo)))).cast("int"))
    # a span of size class k covers at most two bins of width 2 ** (k + 1); those inside it begin in one of them
    holder = own.select(key, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), "_k", F.explode(F.array_distinct(F.array(bin_of(lo, "_k"), bin_of(hi, "_k")))).alias("_bin"))
    sizes = own.groupBy(key).agg(F.collect_set("_k").alias("_ks"))  # at most 63 per key
    probe = own.join(sizes, key).select(key, lo, hi, F.explode(F.filter("_ks", lambda k: k >= F.col("_k"))).alias("_k2"))
    probe = probe.withColumn("_bin", bin_of(lo, "_k2"))
    hit = probe.join(holder.withColumnRenamed("_k", "_k2"), [key, "_k2", "_bin"])
    hit = hit.where((F.col("_lo") <= F.col(lo)) & (F.col(hi) <= F.col("_hi")) & ((F.col("_lo") < F.col(lo)) | (F.col(hi) < F.col("_hi"))))
    best = hit.groupBy(key, lo, hi).agg(F.min(F.struct((F.col("_hi") - F.col("_lo")).alias("n"), F.col("_lo").alias("a"), F.col("_hi").alias("b"))).alias("p"), F.count("*").alias("level"))
    return spans.join(best, [key, lo, hi], "left").select(*spans.columns, F.col("p.a").alias("parent_lo"), F.col("p.b").alias("parent_hi"), F.coalesce("level", F.lit(0)).cast("bigint").alias("level"))


def nested(spans: DataFrame) -> DataFrame:
    """hierarchy() of spans (comp_id, i, j, ...) of which two either hold one another or meet at most at an end.

    One sweep per component over its spans by start, the open ones on a stack: rows and time grow with the spans, however
    deep they nest.
    """

    def kernel(i: np.ndarray, j: np.ndarray) -> tuple:
        by = np.lexsort((-j, i))
        i, j = i[by].tolist(), j[by].tolist()
        up_lo, up_hi, level, held = [], [], [], []
        for at in zip(i, j):
            while held and held[-1][1] < at[1]:
                held.pop()
            lo, hi = held[-1] if held else (None, None)
            up_lo.append(lo)
            up_hi.append(hi)
            level.append(len(held))
            held.append(at)
        return i, j, up_lo, up_hi, level

    found = by_key(spans.select("comp_id", "i", "j"), kernel, "comp_id long, i long, j long, parent_lo long, parent_hi long, level long")
    return spans.join(found, ["comp_id", "i", "j"]).select(*spans.columns, "parent_lo", "parent_hi", "level")


def pvst(links: DataFrame, comps: DataFrame, stack: DataFrame | None = None) -> DataFrame:
    """The bubble tree: (comp_id, i, j, label, start_or, start_id, end_or, end_id, parent_lo, parent_hi, height).

    height is 1 under the component's root (which has no row), one more per enclosing bubble.
    """
    h = nested(written(boundaries(class_stacks(links, comps) if stack is None else stack), "boundaries"))
    return h.withColumn("height", F.col("level") + 1).drop("level")
