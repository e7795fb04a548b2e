"""Merkle manifest of a table: digests of rows, trees of them per group, and proofs by pointer jumping.

Rows are leaves. Those of a group, in order, are cut into runs of 16; a run's digest is a node of the next level, up to
the group's subroot. Subroots, in order of their groups, are the leaves of the top tree, whose last node is the root.

Every node points at the node above it and holds the segment between: the siblings to its left and right. A self-join
replaces each pointer by the pointer of the node it points at and appends that node's segment, so pointers reach twice
as far each round. The leaves of a run share all that stands above it and so travel as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, written

FAN = 16
#: Nodes that meet in one row of a join: a node with more of them below it is copied, and they are dealt over its copies.
SHARE = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOP = "t"


def digest_of(*values: Column) -> Column:
    """Lowercase hex sha256 of the values, each as `-` if null, else its UTF-8 byte count, `:` and itself."""
    text = [v.cast("string") for v in values]
    told = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in text]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _above(size: Column) -> Column:
    return F.ceil(size / F.lit(FAN)).cast("long")


def _levels(size: int) -> int:
    n = 0
    while size > 1:
        size, n = -(-size // FAN), n + 1
    return n


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos, their place from 0 among the rows of their tree by `order`, and size, the rows of their tree.

    Rows are range-sorted by tree and order; a tree's place in a range follows from the counts of it in the ranges
    before, of which there is a row per tree and range. So no tree is gathered in one task.
    """
    by = ("tree", *order)
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id())
    ranged = written(ranged, "ranged").withColumn("_p", F.shiftright("_m", 33))
    parts = ranged.groupBy("tree", "_p").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "_p", "_first", before.alias("_before"), F.sum("_n").over(tree).alias("size"))
    out = ranged.join(parts, ["tree", "_p"]).withColumn("pos", F.col("_m") - F.col("_first") + F.col("_before"))
    return out.select(*rows.columns, "pos", "size")


def _runs(nodes: DataFrame, lvl: int, alone: bool) -> tuple[DataFrame, DataFrame]:
    """(links of nodes(tree, pos, size, digest, weight), nodes above them), where size > 1.

    alone: this tree's root is the manifest's, so links that reach it end.
    """
    runs = nodes.groupBy("tree", F.expr(f"pos div {FAN}").alias("up")).agg(
        F.first("size").alias("size"), F.sum("weight").alias("weight"), F.sort_array(F.collect_list(F.struct("pos", "digest", F.col("weight").alias("w")))).alias("m")
    )
    runs = runs.withColumn("digest", _hash(F.array_join("m.digest", ""))).withColumn("last", _above(F.col("size")) == 1)
    runs = written(runs, "runs")
    one = runs.select("tree", "up", "last", "weight", "digest", "m", F.posexplode("m").alias("i", "x"))
    left, right = F.slice(F.col("m.digest"), F.lit(1), F.col("i")), F.slice(F.col("m.digest"), F.col("i") + 2, F.lit(FAN))
    end = F.col("last") & F.lit(alone)
    links = one.select(
        "tree", F.lit(lvl).alias("lvl"), F.col("x.pos").alias("pos"), F.col("x.w").alias("weight"),
        F.when(~end, F.col("tree")).alias("atree"), F.lit(lvl + 1).alias("alvl"), F.col("up").alias("apos"), F.col("weight").alias("aweight"),
        F.array(F.struct(F.array_join(left, "").alias("b"), F.array_join(right, "").alias("a"))).alias("seg"),
        F.when(F.col("last"), F.col("digest")).alias("sub"),
    )
    return links, runs.select("tree", F.col("up").alias("pos"), _above(F.col("size")).alias("size"), "digest", "weight")


_SEGMENT = "array<struct<b:string,a:string>>"
_LINK = f"tree string, lvl int, pos long, weight long, atree string, alvl int, apos long, aweight long, seg {_SEGMENT}, sub string"


def _jump(links: DataFrame) -> DataFrame:
    """Every pointer replaced by that of the node it points at. A node with many below it has copies that share them."""
    copies = lambda w: F.ceil(w / F.lit(SHARE)).cast("long")
    ends = links.where("atree IS NULL")
    more = links.where("atree IS NOT NULL").withColumn("c", F.pmod(F.xxhash64("tree", "lvl", "pos"), copies(F.col("aweight"))))
    over = links.select(*[F.col(c).alias(f"n_{c}") for c in ("tree", "lvl", "pos", "weight", "atree", "alvl", "apos", "aweight", "seg", "sub")])
    over = over.where("n_lvl > 1 OR n_tree = 't'").withColumn("n_c", F.explode(F.sequence(F.lit(0).cast("long"), copies(F.col("n_weight")) - 1)))
    on = [F.col(a) == F.col(b) for a, b in (("atree", "n_tree"), ("alvl", "n_lvl"), ("apos", "n_pos"), ("c", "n_c"))]
    far = more.join(over, on).select(
        "tree", "lvl", "pos", "weight", F.col("n_atree").alias("atree"), F.col("n_alvl").alias("alvl"), F.col("n_apos").alias("apos"), F.col("n_aweight").alias("aweight"),
        F.concat("seg", "n_seg").alias("seg"), F.coalesce("sub", "n_sub").alias("sub"),
    )
    return ends.unionByName(far)


def proofs(leaves: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Proofs of the rows of (tree, leaf, the columns in keep), ordered within their tree by `_order` columns.

    leaves: tree (string, not null; trees are ordered by it bytewise), leaf (hex digest) and columns named _order1,
    _order2, ... by which a tree's leaves ascend, nulls first; rows that agree in all of them are in no fixed order.
    One row per input row: tree, leaf, subroot, root, proof and the columns in keep. proof is an array of (b, a): the
    digests left and right of the node on the way up, level by level; it is empty where a leaf is the root. An empty
    table has no rows.
    """
    order = sorted(c for c in leaves.columns if c.startswith("_order"))
    total = leaves.groupBy("tree").count().agg(F.count("*").alias("trees"), F.max("count").alias("size")).first()
    trees, largest = total["trees"], total["size"] or 0
    alone = trees == 1
    first = placed(leaves, *order).groupBy("tree", F.expr(f"pos div {FAN}").alias("up")).agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("pos", "leaf", *keep))).alias("m"))
    run_digest = F.when(F.col("size") > 1, _hash(F.array_join("m.leaf", ""))).otherwise(F.element_at("m.leaf", 1))
    runs = written(first.withColumn("digest", run_digest), "runs")

    links, roots = [], []
    nodes = runs.select("tree", F.col("up").alias("pos"), _above(F.col("size")).alias("size"), "digest", F.lit(1).cast("long").alias("weight"))
    for lvl in range(1, _levels(largest) + 1):
        roots.append(nodes.where("size = 1").withColumn("lvl", F.lit(lvl)))
        if lvl < _levels(largest):
            more, nodes = _runs(nodes.where("size > 1"), lvl, alone)
            links.append(more)
    if not roots:  # lone leaves, or none
        roots.append(nodes.withColumn("lvl", F.lit(1)))
    subroots = roots[0]
    for r in roots[1:]:
        subroots = subroots.unionByName(r)

    if alone:
        top, depth = subroots, 0
        end = {"atree": "string", "alvl": "int", "apos": "long", "aweight": "long"}
        links.append(top.select("tree", "lvl", "pos", "weight", *[F.lit(None).cast(t).alias(c) for c, t in end.items()], F.array().cast(_SEGMENT).alias("seg"), F.col("digest").alias("sub")))
    else:
        seats = written(_seated(subroots), "subroots")
        top = seats.select(F.lit(_TOP).alias("tree"), "pos", "size", "digest", "weight")
        depth = _levels(trees)
        up = []
        for lvl in range(depth):
            more, top = _runs(top, lvl, True)
            up.append(more)
        if up:
            seat = up[0].select(F.col("pos").alias("seat"), "atree", "alvl", "apos", "aweight", "seg")
            mine = seats.withColumnRenamed("pos", "seat").join(seat, "seat")
            links.append(mine.select("tree", "lvl", F.lit(0).cast("long").alias("pos"), "weight", "atree", "alvl", "apos", "aweight", "seg", F.col("digest").alias("sub")))
            links += [x.withColumn("sub", F.lit(None).cast("string")) for x in up[1:]]
    spark = leaves.sparkSession
    every = spark.createDataFrame([], _LINK)
    for x in links:
        every = every.unionByName(x)
    every = written(every, "pointers")
    for _ in range(max(0, _levels(largest) + depth - 2).bit_length()):  # the longest way up has levels - 1 + depth links
        further = written(_jump(every), "pointers")
        discard(every)
        every = further
    found = top.select("digest").limit(1).collect()  # one row: the root
    root = F.lit(found[0][0] if found else None).cast("string")

    ends = every.where("lvl = 1 AND tree <> 't'").select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), "seg", "sub")
    own = runs.join(ends, (F.col("tree") == F.col("_tree")) & (F.col("up") == F.col("_pos")))
    one = own.select("tree", "size", "sub", "seg", "m", F.posexplode("m").alias("i", "x"))
    left, right = F.slice(F.col("m.leaf"), F.lit(1), F.col("i")), F.slice(F.col("m.leaf"), F.col("i") + 2, F.lit(FAN))
    here = F.array(F.struct(F.array_join(left, "").alias("b"), F.array_join(right, "").alias("a")))
    proof = F.when(F.col("size") > 1, F.concat(here, F.col("seg"))).otherwise(F.col("seg"))
    return one.select("tree", F.col("x.leaf").alias("leaf"), F.col("sub").alias("subroot"), root.alias("root"), proof.alias("proof"), *[F.col(f"x.{c}").alias(c) for c in keep])


def _seated(subroots: DataFrame) -> DataFrame:
    """Subroots with their place in the top tree."""
    under = subroots.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("_own"), F.col("tree").alias("_order1"), "digest", "weight", "lvl")
    return placed(under, "_order1").select(F.col("_own").alias("tree"), "digest", "weight", "lvl", "pos", "size")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda acc, s: _hash(s["b"], acc, s["a"]))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return _hash(F.array_join(F.transform(proof, lambda s: F.concat(s["b"], s["a"])), ""))


def dataset_manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", altered: Column | None = None, alter=lower_ascii) -> DataFrame:
    """A leaf per row, the manifest's digests, and whether each row's proof still leads to the root.

    One row per input row: the id column, leaf, subroot, root, proof_sha256, folded_root and verified. Where the
    condition `altered` holds, folded_root starts from the leaf of the row with alter(text); elsewhere from its own.
    Groups ascend bytewise, the null group first, and is one of its own; rows of a group ascend by id, null ids first,
    rows of equal ids by leaf. Repeated rows are leaves each; which of equal leaves gets which place is not fixed, and
    their proofs differ. Null fields count as null, empty texts as empty. Columns that are no fields are ignored. An
    empty table has no rows. Each text is read once, in one pass; what is shuffled are digests.
    """
    changed = digest_of(*[alter(F.col(c)) if c == text_col else F.col(c) for c in fields])
    group = F.coalesce(F.concat(F.lit("s+"), F.col(group_col).cast("string")), F.lit("s"))
    cond = F.coalesce(altered, F.lit(False)) if altered is not None else F.lit(False)
    own = docs.select(group.alias("tree"), F.col(id_col).alias("_order1"), digest_of(*[F.col(c) for c in fields]).alias("leaf"), F.when(cond, changed).alias("other"))
    own = own.withColumn("_order2", F.col("leaf")).withColumn("_order3", F.xxhash64(F.monotonically_increasing_id())).withColumn("key", F.col("_order1"))
    own = written(own, "digests")
    p = proofs(own, ("key", "other"))
    discard(own)
    p = p.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("proof")))
    return p.select(F.col("key").alias(id_col), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
