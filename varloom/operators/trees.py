"""Measures of rooted forests, relationally: Euler tours, depths and orders, lowest common ancestors, reach of back edges.

A forest is a table (tree, v, parent), v a number that is one of its own within its tree, parent null at the tree's one
root. Nothing here takes a tree into one task: tours are ranked by pointer doubling, common ancestors are looked up in a
table of range minima, and intervals meet points on dyadic blocks. So one giant tree is as good as many small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.durable import discard, numbered, written


def _doubled(arcs: DataFrame, rounds: int) -> DataFrame:
    """arcs(a, nxt, n, w) with n and w summed from each arc to the end of its list; nxt is null at an end."""
    arcs = written(arcs, "arcs")
    for _ in range(rounds):
        far = arcs.select(F.col("a").alias("nxt"), F.col("nxt").alias("_nxt"), F.col("n").alias("_n"), F.col("w").alias("_w"))
        end = arcs.where("nxt IS NULL")
        on = arcs.where("nxt IS NOT NULL").join(far, "nxt").select("a", F.col("_nxt").alias("nxt"), (F.col("n") + F.col("_n")).alias("n"), (F.col("w") + F.col("_w")).alias("w"))
        further = written(end.unionByName(on), "arcs")
        discard(arcs)
        arcs = further
    return arcs


def tour(forest: DataFrame) -> DataFrame:
    """(tree, pos, v, down, depth, parent, total): the Euler tour of every tree, from pos 0.

    Each vertex stands twice: where the tour comes down to it and where it leaves upwards. Children are taken by rising v.
    total is the number of a tree's vertices. An arc's place follows from the arcs left to the end of its tour, counted by
    pointers that reach twice as far each round; its depth from their signs.
    """
    ranked = numbered(forest.select("tree", "v", "parent"), "tree", "parent", "v", name="i")
    ranked = written(ranked, "ranked")
    kids = ranked.where("parent IS NOT NULL")
    first = kids.groupBy("tree", F.col("parent").alias("v")).agg(F.min("i").alias("first"))
    # brothers stand next to each other in the order by parent and v
    brother = kids.select("tree", "parent", (F.col("i") - 1).alias("i"), F.col("i").alias("brother"))
    parents = ranked.select("tree", F.col("v").alias("parent"), F.col("i").alias("up"))
    near = ranked.join(first, ["tree", "v"], "left").join(brother, ["tree", "parent", "i"], "left").join(parents, ["tree", "parent"], "left")
    down = near.select((2 * F.col("i")).alias("a"), F.coalesce(2 * F.col("first"), 2 * F.col("i") + 1).alias("nxt"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("w"))
    leave = near.select((2 * F.col("i") + 1).alias("a"), F.coalesce(2 * F.col("brother"), 2 * F.col("up") + 1).alias("nxt"), F.lit(1).cast("long").alias("n"), F.lit(-1).cast("long").alias("w"))
    sizes = ranked.groupBy("tree").agg(F.count("*").alias("total"))
    largest = sizes.agg(F.max("total")).first()[0] or 0
    arcs = _doubled(down.unionByName(leave), (2 * largest - 1).bit_length() if largest else 0)
    own = arcs.select(F.shiftright("a", 1).alias("i"), (F.col("a") % 2 == 0).alias("down"), "n", "w").join(ranked, "i").join(sizes, "tree")
    depth = F.when(F.col("down"), -F.col("w")).otherwise(-F.col("w") - 1)
    return own.select("tree", (2 * F.col("total") - F.col("n")).alias("pos"), "v", "down", depth.alias("depth"), "parent", "total")


def measures(euler: DataFrame) -> DataFrame:
    """(tree, v, parent, depth, pre, post, size) from tour(): orders of coming and leaving from 0, vertices of the subtree."""
    both = euler.groupBy("tree", "v").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    pre, size = ((F.col("a") + F.col("depth")) / 2).cast("long"), ((F.col("b") - F.col("a") + 1) / 2).cast("long")
    return both.select("tree", "v", "parent", "depth", pre.alias("pre"), (F.col("b") - pre - size).alias("post"), size.alias("size"))


def range_minima(meta: DataFrame) -> DataFrame:
    """(tree, k, pre, depth, parent): the shallowest of the 2 ** k vertices from pre on, and its parent; the first of equals.

    As many levels as the largest tree's size has bits, each a join of the one before with itself.
    """
    largest = meta.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    level = meta.select("tree", F.lit(0).alias("k"), "pre", "depth", "parent")
    levels = [written(level, "minima")]
    for k in range(1, largest.bit_length()):
        below = levels[-1]
        right = below.select("tree", (F.col("pre") - (1 << (k - 1))).alias("pre"), F.col("depth").alias("_d"), F.col("parent").alias("_p"))
        left = F.col("depth") <= F.col("_d")
        levels.append(written(below.join(right, ["tree", "pre"]).select("tree", F.lit(k).alias("k"), "pre", F.when(left, F.col("depth")).otherwise(F.col("_d")).alias("depth"), F.when(left, F.col("parent")).otherwise(F.col("_p")).alias("parent")), "minima"))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out


def lowest_common(pairs: DataFrame, meta: DataFrame, minima: DataFrame) -> DataFrame:
    """pairs(tree, a, b, ...) with lca, the lowest vertex that holds both.

    Between the first and the second in preorder stands the lca's child towards the second, shallower than all others
    there. Two overlapping blocks of range_minima() cover the range, so a pair is two lookups.
    """
    at = lambda c, name: meta.select("tree", F.col("v").alias(c), F.col("pre").alias(name))
    p = pairs.join(at("a", "_pa"), ["tree", "a"]).join(at("b", "_pb"), ["tree", "b"])
    p = p.withColumn("_lo", F.least("_pa", "_pb") + 1).withColumn("_hi", F.greatest("_pa", "_pb"))
    p = p.withColumn("_k", F.when(F.col("a") != F.col("b"), F.length(F.conv((F.col("_hi") - F.col("_lo") + 1).cast("string"), 10, 2)) - 1))
    p = p.withColumn("_second", F.col("_hi") - _power(F.coalesce("_k", F.lit(0))) + 1)
    block = lambda at, d, q: minima.select("tree", F.col("k").alias("_k"), F.col("pre").alias(at), F.col("depth").alias(d), F.col("parent").alias(q))
    p = p.join(block("_lo", "_d1", "_p1"), ["tree", "_k", "_lo"], "left").join(block("_second", "_d2", "_p2"), ["tree", "_k", "_second"], "left")
    lca = F.when(F.col("_k").isNull(), F.col("a")).when(F.col("_d1") <= F.col("_d2"), F.col("_p1")).otherwise(F.col("_p2"))
    return p.select(*pairs.columns, lca.alias("lca"))


def _power(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), k)


def _blocks(lo: Column, hi: Column) -> Column:
    """Dyadic blocks (k, number) that together are lo to hi: at most two of each size."""
    left = lambda k: F.call_function("shiftright", lo + _power(k) - 1, k)
    right = lambda k: F.call_function("shiftright", hi + 1, k)
    odd = lambda x: x % 2 == 1
    sizes = F.sequence(F.lit(0), F.length(F.conv((hi + 1).cast("string"), 10, 2)))

    def of(k: Column) -> Column:
        one = F.when((left(k) < right(k)) & odd(left(k)), F.struct(k.alias("k"), left(k).alias("block")))
        two = F.when((left(k) < right(k)) & odd(right(k)), F.struct(k.alias("k"), (right(k) - 1).alias("block")))
        return F.array(one, two)

    return F.filter(F.flatten(F.transform(sizes, of)), lambda x: x.isNotNull())


def reach(meta: DataFrame, back: DataFrame) -> DataFrame:
    """(tree, v, lo, hid): what back edges pass each vertex.

    back(tree, src, tgt): edges from a vertex to one above it. An edge passes the vertices that stand between its ends in
    preorder, which are below its target. lo is the deepest target of those that pass v, hid the shallowest source, the
    first in preorder of equals; null where none passes. Edges are cut into dyadic blocks of preorder places and the
    blocks' best taken first, so a row per block and size meets each vertex, however many edges pass it.
    """
    end = lambda c, name: meta.select("tree", F.col("v").alias(c), F.col("pre").alias(f"_{name}"), F.col("depth").alias(f"_{name}d"))
    e = back.join(end("src", "s"), ["tree", "src"]).join(end("tgt", "t"), ["tree", "tgt"]).where("_s > _t + 1")
    cut = e.select("tree", F.explode(_blocks(F.col("_t") + 1, F.col("_s") - 1)).alias("x"), F.struct(F.col("_td").alias("d"), F.col("tgt").alias("v")).alias("lo"), F.struct(F.col("_sd").alias("d"), F.col("_s").alias("p"), F.col("src").alias("v")).alias("hid"))
    best = cut.groupBy("tree", "x.k", "x.block").agg(F.max("lo").alias("lo"), F.min("hid").alias("hid"))
    ks = F.sequence(F.lit(0), F.lit(62))
    top = best.groupBy("tree").agg(F.max("k").alias("_top"))
    points = meta.join(top, "tree", "left").select("tree", "v", "pre", F.explode(F.filter(ks, lambda k: k <= F.coalesce("_top", F.lit(0)))).alias("k"))
    met = points.withColumn("block", F.expr("shiftright(pre, k)")).join(best, ["tree", "k", "block"], "left")
    return met.groupBy("tree", "v").agg(F.max("lo").alias("lo"), F.min("hid").alias("hid")).select("tree", "v", F.col("lo.v").alias("lo"), F.col("hid.v").alias("hid"))
