"""Near-duplicate documents by DartMinHash signatures and banded joining, verified exactly.

A text is a weighted set: its shingles, each with how often it stands there. Every element owns a region of weight x
rank. Darts fall on it as a hashed Poisson process that depends on the element alone; each has a rank, a place along the
weight, and a coordinate. A signature keeps the dart of the earliest rank for each coordinate among those that hit the
set's regions. Only darts below a rank that shrinks with the set's weight need to be thrown, so a signature costs about
k ln k darts whatever the text's length. Two signatures agree at a coordinate with the chance of their weighted Jaccard
similarity, the sum of the least weights over the sum of the greatest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import on_workers
from ._common import arrow_map, components, written
from .shingles import counted, mix, repeats_apart, salt, shingle_set, shingles, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: At similarity 0.8 a pair shares no band with probability (1 - 0.8 ** 5) ** 30, below 0.00001.
BANDS, ROWS = 30, 5
#: Shingles and rows of a bucket that a block holds (a longer text is a block by itself); a task compares two blocks.
BLOCK, BLOCK_ROWS = 200_000, 1000
_FIRST = 0.125  # ranks are cut into [0, 1/8) and intervals that double


def _poisson_cdf(mean: float) -> np.ndarray:
    n = int(mean + 12 * mean**0.5 + 20)
    logs = -mean + np.arange(n) * np.log(mean) - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n)))])
    return np.cumsum(np.exp(logs))


_CDF: dict[int, np.ndarray] = {}


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_signatures(sets: list[np.ndarray], k: int, weights: list[np.ndarray] | None = None) -> np.ndarray:
    """Signatures (len(sets) x k, 64-bit) of weighted sets given as hashes and positive weights. Empty sets get zeros.

    Without weights each element counts 1. An element's region is cut along its weight into cells of width 1, the last
    one in part, each with darts of its own; a dart beyond the weight misses.
    """
    sig = np.zeros((len(sets), k), np.uint64)
    want = k * np.log(k) + 2 * k
    weights = [np.ones(len(s)) for s in sets] if weights is None else [np.asarray(w, float) for w in weights]
    todo = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    theta = np.array([want / w.sum() if len(w) else 0.0 for w in weights])
    while len(todo):
        left = []
        at = 0
        while at < len(todo):  # groups of sets with about half a million cells and darts
            part, load = [], 0.0
            while at < len(todo) and (not part or load < 500_000):
                load += weights[todo[at]].sum() + want
                part.append(todo[at])
                at += 1
            left += _throw([sets[i] for i in part], [weights[i] for i in part], np.array(part), theta, k, sig)
        todo = np.array(left, np.int64)
        theta[todo] *= 2
    return sig


def _cells(sets: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, width) of the cells of width 1 or less that the elements' regions are cut into."""
    h, w = np.concatenate(sets), np.concatenate(weights)
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    many = np.maximum(1, np.ceil(w)).astype(np.int64)
    if (many > 1).any():
        src = np.repeat(np.arange(len(h)), many)
        nth = np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many)
        h, w, owner = repeats_apart(h[src], nth), np.minimum(1.0, w[src] - nth), owner[src]
    return h, owner, w


def _throw(sets: list[np.ndarray], weights: list[np.ndarray], part: np.ndarray, theta: np.ndarray, k: int, sig: np.ndarray) -> list[int]:
    """Fills the signatures of part; returns those with a coordinate that no dart reached."""
    h, owner, width = _cells(sets, weights)
    limit = theta[part]
    best = np.full(len(part) * k, np.inf)
    thrown = []
    level, low, high = 0, 0.0, _FIRST
    while low < limit.max():
        live = slice(None) if level == 0 else np.flatnonzero(limit[owner] > low)
        e, o, wide = h[live], owner[live], width[live]
        if level not in _CDF:
            _CDF[level] = _poisson_cdf(high - low)
        many = np.searchsorted(_CDF[level], _unit(mix(e ^ salt(2 * level))))
        src = np.repeat(np.arange(len(e)), many)
        if len(src):
            nth = np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many)
            dart = mix(mix(e[src] ^ salt(2 * level + 1)) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            rank = low + (high - low) * _unit(dart)
            ok = rank < limit[o[src]]
            if (wide < 1).any():
                ok &= _unit(mix(dart + np.uint64(1))) < wide[src]
            dart, rank, o = dart[ok], rank[ok], o[src][ok]
            cell = o * k + (mix(dart) % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, cell, rank)
            thrown.append((cell, rank, dart))
        level, low, high = level + 1, high, high * 2
    flat = np.zeros(len(part) * k, np.uint64)
    for cell, rank, dart in thrown:
        first = best[cell] == rank
        flat[cell[first]] = dart[first]
    full = np.isfinite(best.reshape(-1, k)).all(1)
    sig[part[full]] = flat.reshape(-1, k)[full]
    return part[~full].tolist()


def signatures(docs: DataFrame, *, id_col: str, text_col: str, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE) -> DataFrame:
    """(id, d1, d2, n, keys): digest of the words, number of shingles with their repeats, band keys. Texts without words have no keys.

    Rows with a null id are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                words = word_hashes(batch.column(1))
                sets, weights = zip(*(counted(shingles(w, size)) for w in words)) if words else ((), ())
                sig = dart_signatures(list(sets), bands * rows, list(weights))
                keys = np.zeros((len(sets), bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys * np.uint64(0x100000001B3) + sig[:, r * bands : (r + 1) * bands] + np.uint64(r + 1))
                keys = mix(keys ^ np.array([salt(1000 + b) for b in range(bands)], np.uint64)).view(np.int64)
                dig = np.array([xxhash.xxh3_128_intdigest(w.tobytes()) for w in words], object)
                signed = lambda x: x - (1 << 64) if x >> 63 else x
                full = np.array([len(s) > 0 for s in sets], bool)
                counts = np.where(full, bands, 0)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([signed(int(x) >> 64) for x in dig], pa.int64()),
                        pa.array([signed(int(x) & (1 << 64) - 1) for x in dig], pa.int64()),
                        pa.array([int(w.sum()) for w in weights], pa.int32()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel(), pa.int64())),
                    ],
                    names=["id", "d1", "d2", "n", "keys"],
                )

    return arrow_map(docs.where(F.col(id_col).isNotNull()).select(id_col, text_col), run, f"id {kind}, d1 long, d2 long, n int, keys array<long>")


def shingle_sets(docs: DataFrame, *, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """(id, s): every text's shingles as hashes, the n-th of equal ones by a hash of its own.

    As sets these have the Jaccard similarity that the weighted sets have.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                sets = [shingle_set(w, size).view(np.int64) for w in word_hashes(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    return arrow_map(docs.select(id_col, text_col), run, f"id {kind}, s array<long>")


def _compare(t: pa.Table, num: int) -> pa.Table:
    """Edges (a, b) that span the links between rows of different roots, in one block of a bucket or across two."""
    t = t.combine_chunks()
    ids, root, block = (t.column(c).to_numpy().copy() for c in ("rep", "root", "block"))
    cross = t.column("p")[0].as_py() != t.column("q")[0].as_py()
    lists = t.column("s").chunk(0)
    size = np.diff(lists.offsets.to_numpy())
    key, code, freq = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(size)), size)
    row, code = row[freq[code] > 1], code[freq[code] > 1]
    code = np.unique(code, return_inverse=True)[1] if len(code) else code
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    both = np.zeros((len(size), len(size)), np.float32)
    for c in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):  # shared shingles, some columns at a time
        a, b = np.searchsorted(code, [c, c + 4096])
        part = np.zeros((len(size), 4096), np.float32)
        part[row[a:b], code[a:b] - c] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    near = both * 10_000 >= num * (size[:, None] + size[None, :] - both)
    near &= root[:, None] != root[None, :]
    if cross:
        near &= block[:, None] != block[None, :]
    edges = []
    for i in np.flatnonzero(near.any(1)):
        for j in np.flatnonzero(near[i] & (root != root[i])):
            if root[i] != root[j]:
                edges.append((int(ids[i]), int(ids[j])))
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Classes of documents linked by a Jaccard similarity of at least `similarity` on their sets of `size`-word shingles.

    One row per distinct non-null id: the id column, class_id (the smallest id reachable by links), kept (the id is its
    class's) and linked_id (a document that this one is verified against: the first with the same words, else of those
    linked with it the smallest; null where it is the first of its words and links with no others). The similarity is the weighted one, on shingles with
    their numbers. Texts with the same words are one class and are compared once. A text of fewer than `size` words is
    one shingle; texts without words (null, empty, white space) link with nothing. If an id repeats with different
    texts, its smallest class counts.

    Candidates share a band key. Every text is first compared with one hub, the text of its buckets that shares the
    most of others. Where this leaves a bucket in several classes, all rows outside of its largest class so far are
    compared with all others of the bucket, in blocks of a bounded number of shingles, two blocks a task; only edges
    that span the links leave them, never all pairs. The id must be an integer.
    """
    num = round(similarity * 10_000)
    sig = written(signatures(docs, id_col=id_col, text_col=text_col, bands=bands, rows=rows, size=size), "signatures")
    copies = sig.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    reps = written(copies, "reps")
    # buckets with at least two texts, and the text in each that shares most buckets' places
    keyed = reps.select("rep", "n", F.explode("keys").alias("key"))
    crowd = written(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "crowd")
    shared = written(keyed.join(crowd, "key").select("key", "rep", "n", "c"), "buckets")
    members = shared.groupBy("rep").agg((-F.sum("c")).alias("w"))
    text = docs.select(F.col(id_col).alias("id"), text_col)
    sets = written(shingle_sets(text.join(members.select(F.col("rep").alias("id")).hint("shuffle_hash"), "id", "left_semi"), id_col="id", text_col=text_col, size=size), "sets")
    weighed = shared.join(members, "rep")
    hubs = weighed.groupBy("key").agg(F.min(F.struct("w", "rep")).alias("hub"))
    first = weighed.join(hubs, "key").groupBy("rep").agg(F.min("hub").alias("hub")).select(F.col("rep").alias("a"), F.col("hub.rep").alias("b")).where("a <> b")
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    similar = both * 10_000 >= num * (F.size("sa") + F.size("sb") - both)
    links = written(first.join(left, "a").join(right, "b").where(similar).select("a", "b"), "links")
    # what this leaves apart in a bucket: all its members across classes, within a task or a pair of blocks
    roots = written(components(links), "roots")
    now = shared.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root"))
    apart = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    now = written(now.join(apart, "key"), "apart")
    parts = now.groupBy("key", "root").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    major = parts.groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"))
    parts = parts.join(major, "key")
    is_major = F.col("root") == F.col("top.root")
    # blocks of the largest class are numbered after those of the others
    blocks = lambda mine: F.ceil(F.greatest(F.sum(F.when(mine, F.col("w")).otherwise(0)) / BLOCK, F.sum(F.when(mine, F.col("m")).otherwise(0)) / BLOCK_ROWS)).cast("int")
    sizes = parts.groupBy("key").agg(F.first("top.root").alias("top"), blocks(~is_major).alias("n_rest"), blocks(is_major).alias("n_top"))
    place = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    of_top = F.col("root") == F.col("top")
    rest = now.join(sizes, "key").withColumn("block", F.when(of_top, F.col("n_rest") + place(F.col("n_top"))).otherwise(place(F.col("n_rest"))))
    # rows of the rest meet every block, rows of the largest class those of the rest alone
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(of_top, F.col("n_rest")).otherwise(F.col("n_rest") + F.col("n_top")) - 1)))
    rest = rest.select("key", "rep", "root", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    sized = rest.join(sets.withColumnRenamed("id", "rep"), "rep")
    on_workers(docs.sparkSession)
    more = sized.groupBy("key", "p", "q").applyInArrow(lambda t: _compare(t, num), "a long, b long")
    links = written(links.unionByName(more.distinct()), "links")
    roots = components(links)
    mates = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("mate"))
    found = roots.withColumnRenamed("id", "rep").join(mates.withColumnRenamed("a", "rep"), "rep", "left")
    rep = sig.join(reps.select("d1", "d2", "rep"), ["d1", "d2"], "left").select("id", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")).alias("rep"))
    out = rep.join(found, "rep", "left").select("id", F.coalesce("root", "rep").alias("class_id"), F.when(F.col("id") != F.col("rep"), F.col("rep")).otherwise(F.col("mate")).alias("linked_id"))
    out = out.groupBy("id").agg(F.min("class_id").alias("class_id"), F.min("linked_id").alias("linked_id"))
    return out.select(F.col("id").alias(id_col), "class_id", (F.col("id") == F.col("class_id")).alias("kept"), "linked_id")
