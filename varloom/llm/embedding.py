"""Near-duplicate vectors by a forest of random-projection trees with spill, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, components, written

#: The forest is laid out on a sample of about so many vectors at most and, of each length in proportion to its part of
#: the table, of so many numbers, drawn by hash over the whole table. They bound the driver's memory.
SAMPLE, SAMPLE_NUMBERS = 50_000, 4_000_000
#: LEAF: vectors of a label that a leaf is expected to hold at most.
TREES, LEAF, MAX_DEPTH, MIN_SAMPLE = 4, 256, 16, 16


@dataclass
class Forest:
    """Per tree: directions by level, and by node (root 1, children 2i and 2i + 1) its threshold (nan: a leaf) and blocks.

    A leaf that is expected to hold far more than LEAF vectors of a label is dealt out as pairs of blocks.
    """

    directions: np.ndarray
    threshold: list[dict[int, float]]
    blocks: list[dict[int, int]]
    margin: float

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, tree * 2 ** 32 + node, blocks) of every leaf that each unit vector falls in, rows ascending."""
        rows, ids, blocks = [], [], []
        for t, (threshold, nb) in enumerate(zip(self.threshold, self.blocks)):
            todo = {1: np.arange(len(x))}
            level = 0
            while todo:
                p = x @ self.directions[t, level] if level < self.directions.shape[1] else None
                after: dict[int, np.ndarray] = {}
                for node, who in todo.items():
                    if node in threshold:
                        v, at = p[who], threshold[node]
                        for child, side in ((2 * node, v <= at + self.margin), (2 * node + 1, v >= at - self.margin)):
                            if side.any():
                                after[child] = who[side]
                    else:
                        rows.append(who)
                        ids.append(np.full(len(who), (t << 32) + node, np.int64))
                        blocks.append(np.full(len(who), nb.get(node, 1), np.int64))
                todo, level = after, level + 1
        if not rows:
            return (np.zeros(0, np.int64),) * 3
        row, leaf, block = np.concatenate(rows), np.concatenate(ids), np.concatenate(blocks)
        order = np.lexsort((leaf, row))
        return row[order], leaf[order], block[order]


def unit_rows(vectors: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors as double of lists that all hold `dim` finite numbers, not all 0; read from the flat buffer."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(1, initial=0, keepdims=True)
    x /= np.sqrt((x * x).sum(1))[:, None]
    return x


def grow_forest(x: np.ndarray, label: np.ndarray, scale: float, similarity: float, *, trees: int = TREES, leaf: int = LEAF, seed: int = 5) -> Forest:
    """Recursive splits at the median along random directions until no label is expected to fill a leaf.

    scale: rows of the table per row of the sample. Rows within the margin of a threshold go to both sides. A pair at
    the least linked similarity differs along a random direction by a normal deviate of deviation d / sqrt(dim), d its
    distance; the margin is that deviation on either side, so a level parts such a pair with a chance of about 0.0014,
    and all trees part it with one of under 0.000001 at the depths used.
    """
    dim = x.shape[1]
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((trees, MAX_DEPTH, dim))
    directions /= np.sqrt((directions**2).sum(2))[:, :, None]
    margin = float(np.sqrt(max(2 - 2 * similarity, 1e-12) / dim))
    thresholds, blocks = [], []
    codes = np.unique(label, return_inverse=True)[1] if len(label) else np.zeros(0, np.int64)
    for t in range(trees):
        threshold: dict[int, float] = {}
        nb: dict[int, int] = {}
        todo = [(1, np.arange(len(x)), 0)]
        while todo:
            node, who, level = todo.pop()
            most = np.bincount(codes[who]).max() * scale if len(who) else 0
            if most > leaf and level < MAX_DEPTH and len(who) >= MIN_SAMPLE:
                v = x[who] @ directions[t, level]
                at = float(np.median(v))
                left, right = who[v <= at + margin], who[v >= at - margin]
                if max(len(left), len(right)) <= 0.8 * len(who):
                    threshold[node] = at
                    todo += [(2 * node, left, level + 1), (2 * node + 1, right, level + 1)]
                    continue
                if level + 1 < MAX_DEPTH and len(who) > 4 * leaf / max(scale, 1):  # this direction doesn't part them; others may
                    threshold[node] = float("inf")
                    todo.append((2 * node, who, level + 1))
                    continue
            if most > 4 * leaf:
                nb[node] = int(-(-most // (2 * leaf)))
        thresholds.append(threshold)
        blocks.append(nb)
    return Forest(directions, thresholds, blocks, margin)


def links_in(x: np.ndarray, ids: np.ndarray, mult: np.ndarray, block: np.ndarray, leaves: list, here: int, cross: bool, similarity: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(linked rows by row, edges that span the links) of one leaf, or of two of its blocks if cross.

    A pair counts only in the first leaf that both fall in, so that no pair of rows need be sent anywhere to be counted
    once. Rows are compared 512 at a time.
    """
    n = len(x)
    count = np.zeros(n, np.int64)
    root = np.arange(n)
    early = [[v for v in own if v < here] for own in leaves]
    codes = {v: i for i, v in enumerate(sorted({v for own in early for v in own}))}
    member = np.zeros((n, len(codes)), np.float32)
    for i, own in enumerate(early):
        for v in own:
            member[i, codes[v]] = 1
    for a in range(0, n, 512):
        b = min(n, a + 512)
        near = x[a:b] @ x.T >= similarity
        near[np.arange(b - a), np.arange(a, b)] = False
        if cross:
            near &= block[a:b, None] != block[None, :]
        if codes and near.any():
            near &= member[a:b] @ member.T == 0
        count[a:b] = near @ mult
        for i in np.flatnonzero(near.any(1)):
            found = np.unique(root[near[i]])
            low = min(found[0], root[a + i])
            if found[-1] != low or root[a + i] != low:
                root[np.isin(root, found) | (root == root[a + i])] = low
    return count, [(int(ids[i]), int(ids[root[i]])) for i in range(n) if root[i] != i]


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", similarity: float = 0.98, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """Links between vectors of equal label and length whose cosine in double precision is at least `similarity`.

    One row per input row: the id column, n_links (other vectors linked directly), component_id (the smallest id
    reachable by links, itself included) and kept (the id is its component's). Vectors that are null, empty, zero or
    hold null or non-finite components, and rows with a null label or id, link with nothing. Equal vectors of a label
    are compared as one row with its multiplicity and their links counted. The id must be an integer.

    Rows of an empty table give none; other columns are ignored. The forest is laid out on a bounded sample, the same on every run; every row is sent through it. Leaves of a label are compared within,
    oversized ones by pairs of blocks, and only counts and spanning edges leave a leaf.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    bad = lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf"))
    sound = sound & ~F.exists("v", bad) & F.exists("v", lambda e: e != 0)
    norm = F.transform("v", lambda e: e.cast("double") + 0.0)
    keyed = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("k1", F.when(F.col("sound"), F.xxhash64(norm))).withColumn("k2", F.when(F.col("sound"), F.xxhash64(F.lit(1), norm)))
    reps = keyed.where("sound").groupBy("label", "k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.first("v").alias("v"))
    reps = written(reps, "vectors")
    n = reps.count()
    # a length's share of the sample follows from its own width, so that a wide vector narrows no others
    size = F.size("v")
    share = F.least(F.lit(1.0), F.least(F.lit(float(sample)), F.lit(float(SAMPLE_NUMBERS)) / size) / max(n, 1))
    draw = F.pmod(F.xxhash64("k1", "rep"), F.lit(1 << 40)) / float(1 << 40)
    picked = reps.where(draw < share).select("label", "v", size.alias("dim"), share.alias("share")).limit(int(1.2 * sample) + 100).toArrow().combine_chunks()
    forests: dict[int, Forest] = {}
    dims = picked.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        part = picked.take(pa.array(np.flatnonzero(dims == dim))).combine_chunks()
        names = np.array([str(v) for v in part.column("label").to_pylist()])
        forests[dim] = grow_forest(unit_rows(part.column("v").chunk(0), dim), names, 1 / part.column("share")[0].as_py(), similarity, trees=trees, leaf=leaf)

    label_type = reps.schema["label"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per leaf, or per pair of blocks of a leaf: (label, dim, leaf, p, q, rep, mult, block, leaves, v)."""
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                size = pc.list_value_length(batch.column(3)).to_numpy()
                for dim in np.unique(size).tolist():
                    mine = np.flatnonzero(size == dim)
                    x = unit_rows(batch.column(3).take(pa.array(mine)), dim)
                    if dim in forests:
                        r, leaf_id, blocks = forests[dim].leaves(x)
                    else:  # a length that the sample doesn't hold: one leaf
                        r, leaf_id, blocks = np.arange(len(mine)), np.ones(len(mine), np.int64), np.ones(len(mine), np.int64)
                    reps_of = batch.column(1).to_numpy()[mine]
                    own = np.split(leaf_id, np.flatnonzero(np.diff(r)) + 1) if len(r) else []
                    src, leaf_out, p, q, blk = [], [], [], [], []
                    for i, lf, nb in zip(r, leaf_id, blocks):
                        b = int(reps_of[i] * 2654435761 % 4294967296 % nb)
                        for o in range(nb):
                            src.append(i)
                            leaf_out.append(lf)
                            p.append(min(b, o))
                            q.append(max(b, o))
                            blk.append(b)
                    src = np.array(src, np.int64)
                    idx = pa.array(mine[src] if len(src) else src)
                    raw = [x[i].tobytes() for i in src]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(idx), pa.array(np.full(len(src), dim), pa.int32()), pa.array(leaf_out, pa.int64()), pa.array(p, pa.int32()), pa.array(q, pa.int32()), batch.column(1).take(idx), batch.column(2).take(idx), pa.array(blk, pa.int32()), pa.array([own[i] for i in src], pa.list_(pa.int64())), pa.array(raw, pa.binary())],
                        names=["label", "dim", "leaf", "p", "q", "rep", "mult", "block", "leaves", "v"],
                    )

    placed = arrow_map(reps.select("label", "rep", "mult", "v"), place, f"label {label_type}, dim int, leaf long, p int, q int, rep long, mult long, block int, leaves array<long>, v binary")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        v = t.column("v").chunk(0)
        ends = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1]
        x = np.frombuffer(v.buffers()[2], np.float64, (ends[-1] - ends[0]) // 8, ends[0]).reshape(t.num_rows, -1)
        ids = t.column("rep").to_numpy()
        cross = t.column("p")[0].as_py() != t.column("q")[0].as_py()
        count, edges = links_in(x, ids, t.column("mult").to_numpy(), t.column("block").to_numpy(), t.column("leaves").to_pylist(), t.column("leaf")[0].as_py(), cross, similarity)
        hit = np.flatnonzero(count)
        a = np.concatenate([ids[hit], np.array([e[0] for e in edges], np.int64)])
        b = np.concatenate([np.full(len(hit), -1), np.array([e[1] for e in edges], np.int64)])
        c = np.concatenate([count[hit], np.zeros(len(edges), np.int64)])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(c, pa.int64()), "edge": pa.array([False] * len(hit) + [True] * len(edges), pa.bool_())})

    found = written(placed.groupBy("label", "dim", "leaf", "p", "q").applyInArrow(compare, "a long, b long, n long, edge boolean"), "links")
    counts = found.where("NOT edge").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("more"))
    roots = components(found.where("edge").select("a", "b")).withColumnRenamed("id", "rep")
    per_rep = reps.join(counts, "rep", "left").join(roots, "rep", "left").select("label", "k1", "k2", (F.col("mult") - 1 + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("root", "rep").alias("c"))
    out = keyed.join(per_rep, ["label", "k1", "k2"], "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").cast(vectors.schema[id_col].dataType).alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
