"""Ranked lexical search: the best k documents of every item, by the Best Position Algorithm over impact lists.

Documents are dealt into shards. A shard has an impact list for each term that items hold: its documents by falling
impact. For an item the lists of its terms are read from the top, all to the same depth; each document met is looked up
in all other lists (direct access), which tells its whole score and its places there. A list's best position is the last
one up to which every place has been seen, by reading or by direct access, so it lies at or beyond the last place read.
No document unseen so far can score more than the sum of the impacts at the best positions. Reading stops when that sum
is strictly below the k-th best score, so that ties still count.

Statistics are taken over all documents first; a shard's best k then hold every document of it that is among the best k
of all, and the shards' winners are merged.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_map, discard, written

TOP = 10
#: Places of all lists that a shard holds, which bounds a task's memory; a document of more is a shard by itself.
SHARD_PLACES = 1_500_000
#: Different terms of the items that are answered together, which bounds what every task is sent.
TERMS_AT_ONCE = 200_000
FIRST_DEPTH = 16
#: Partial winners of an item are merged in so many groups first.
MERGE = 64
#: Bytes that part terms become blanks, A-Z become a-z, all others (and all of letters beyond ASCII) stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of everything beyond ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What each occurrence count is worth in a document of length factor m, before the term's weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Lists:
    """The impact lists of a shard.

    docs, term, tf: a row per document and term of it (documents by place in the shard); m: length factor per document.
    """

    def __init__(self, docs: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, n_terms: int):
        f = impact(tf, m[docs])
        order = np.lexsort((docs, -f, term))
        self.doc, self.f = docs[order], f[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        keys = term.astype(np.int64) * len(m) + docs
        self.n_docs, by_key = len(m), np.argsort(keys, kind="stable")
        self.keys, self.place = keys[by_key], place[by_key]

    def look_up(self, term: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Places of each document in each term's list, -1 where it doesn't stand: len(term) x len(docs)."""
        want = term[:, None].astype(np.int64) * self.n_docs + docs[None, :]
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, self.place[at], -1)

    def best(self, term: np.ndarray, weight: np.ndarray, k: int, floor: int, ids: np.ndarray, first: int = FIRST_DEPTH, trace: list | None = None) -> list[tuple[int, int]]:
        """(score, document) of the shard's best k that reach `floor`, by score, then id: ties at the k-th stay out by id.

        floor: a score that k other documents are known to reach; those of less need not be found.
        """
        keep = (weight > 0) & (self.start[term + 1] > self.start[term])
        term, weight = term[keep], weight[keep]
        if not len(term):
            return []
        begin, size = self.start[term], self.start[term + 1] - self.start[term]
        at = np.concatenate([[0], np.cumsum(size)])
        seen = np.zeros(at[-1], bool)  # places of this item's lists, one list after another
        known = np.zeros(self.n_docs, bool)
        best = np.zeros(len(term), np.int64)  # places of each list from its top that are all seen
        scores, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, done = first, 0
        while True:
            read = [self.doc[b + min(done, n) : b + min(depth, n)] for b, n in zip(begin, size)]
            new = np.unique(np.concatenate(read))
            new = new[~known[new]]
            if len(new):
                known[new] = True
                place = self.look_up(term, new)
                hit = place >= 0
                score = (np.where(hit, self.f[np.maximum(place, 0)], 0) * weight[:, None]).sum(0)
                seen[(place - begin[:, None] + at[:-1, None])[hit]] = True
                scores, found = np.concatenate([scores, score]), np.concatenate([found, new])
                if len(scores) > k:  # of those that can't be among the best k only the count of reads is of use
                    kth = np.partition(scores, -k)[-k]
                    top = scores >= kth
                    scores, found = scores[top], found[top]
            bound = 0
            for i in range(len(term)):
                own = seen[at[i] + best[i] : at[i + 1]]
                best[i] = size[i] if own.all() else best[i] + int(np.argmin(own))
                if best[i] < size[i]:  # an unseen document stands after the best position
                    bound += int(self.f[begin[i] + max(best[i] - 1, 0)]) * int(weight[i])
            kth = max(floor, int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0)
            if trace is not None:
                trace.append((depth, best.copy(), bound, kth))
            if bound == 0 or bound < kth:
                break
            done, depth = depth, 2 * depth
        good = (scores > 0) & (scores >= floor)
        scores, found = scores[good], found[good]
        order = np.lexsort((ids[found], -scores))[:k]
        return [(int(scores[i]), int(found[i])) for i in order]


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, terms with their numbers) of every item with a term; of the texts of one id the first in order counts."""
    one = items.groupBy(F.col(id_col).alias("item")).agg(F.min(text_col).alias("text"))
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = [Counter(terms(x.as_py())) if x.is_valid else Counter() for x in batch.column(1).cast(pa.binary())]
            own = [[{"t": t, "n": n} for t, n in sorted(c.items())] for c in count]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.struct([("t", pa.binary()), ("n", pa.int64())])))], names=["item", "terms"])

    return arrow_map(one.select("item", "text"), run, f"item {kind}, terms array<struct<t:binary,n:bigint>>").where("size(terms) > 0")


def _postings(docs: DataFrame, id_col: str, text_col: str, number: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tf) of every document with a term: its number of terms, and those of `number` with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, which, often, rows = [], [], [], []
            for i, x in enumerate(batch.column(1).cast(pa.binary())):
                own = terms(x.as_py()) if x.is_valid else []
                if own:
                    c = Counter(own)
                    mine = [(number[t], v) for t, v in c.items() if t in number]
                    rows.append(i)
                    length.append(len(own))
                    which.append([a for a, _ in mine])
                    often.append([b for _, b in mine])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(length, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(often, pa.list_(pa.int64()))], names=["id", "n", "terms", "tf"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col), F.col(text_col)), run, f"id {kind}, n long, terms array<int>, tf array<long>")


def _answer(postings: DataFrame, asked: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_words: int, n_terms: int, k: int, shard_places: int) -> DataFrame:
    """(q, id, score): the best k of each shard for each of the asked (terms, weights); a task's shards share their floors."""

    def answer(rows: list[tuple], floors: list[list[int]]) -> Iterator[tuple[int, int, int]]:
        docs = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        term = np.concatenate([r[2] for r in rows])
        tf = np.concatenate([r[3] for r in rows])
        m = np.array([25 + (75 * r[1] * n_docs) // n_words for r in rows], np.int64)
        ids = np.array([-(1 << 63) if r[0] is None else r[0] for r in rows], np.int64)
        lists = Lists(docs, term, tf, m, n_terms)
        for q, (t, w) in enumerate(asked):
            floor = floors[q][0] if len(floors[q]) == k else 0
            for score, d in lists.best(t, w, k, floor, ids):
                (heapq.heappush if len(floors[q]) < k else heapq.heappushpop)(floors[q], score)
                yield q, d, score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: list[list[int]] = [[] for _ in asked]
        rows, held = [], 0

        def out() -> pa.RecordBatch:
            won = list(answer(rows, floors))
            ids = pa.array([rows[d][0] for _, d, _ in won], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([q for q, _, _ in won], pa.int32()), ids, pa.array([s for _, _, s in won], pa.int64())], names=["q", "id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                which = batch.column(2)[i].values.to_numpy()
                if not len(which):
                    continue
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), which, batch.column(3)[i].values.to_numpy()))
                held += len(which)
                if held >= shard_places:
                    yield out()
                    rows, held = [], 0
        if rows:
            yield out()

    return arrow_map(postings, run, "q int, id long, score long")


def ranked(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = TOP, shard_places: int = SHARD_PLACES, terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """The k best documents of every item: the item's id, rank from 1, the document's id (an integer) and score.

    Only scores above 0 count, so an item may have fewer or none; equal scores rank by ascending id, a null id first.
    Null and empty texts hold no terms. Each row of docs is a document, so repeated rows rank one after another; rows of
    items with one id are one item, that of the first text in order, and a null item id is an item like others. An item
    without terms, and an empty table of either, gives no rows. Other columns are ignored.

    Documents are read once per block of items (terms_at_once bounds a block's vocabulary), cut into terms and written
    as counts of the block's terms; numbers over all of them give weights and lengths. The shards' winners, k an item and
    shard, are all that is shuffled.
    """
    own = written(_items(items, item_col, item_text_col), "items")
    total = own.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // terms_at_once))
    spark = docs.sparkSession
    kinds = {c: own.schema["item"].dataType if c == "item" else docs.schema[id_col].dataType for c in ("item", "id")}
    out = None
    for b in range(blocks):
        block = own.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "terms").toArrow()
        names, sets = block.column("item").to_pylist(), block.column("terms").to_pylist()
        number = {t: i for i, t in enumerate(sorted({x["t"] for s in sets for x in s}))}
        postings = written(_postings(docs, id_col, text_col, number), "postings")
        n_docs, n_words = postings.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(number), np.int64)
        counts = postings.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
        df[counts.column("t").to_numpy()] = counts.column("count").to_numpy()
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        asked = []
        for s in sets:
            t = np.array([number[x["t"]] for x in s], np.int64)
            asked.append((t, weight[t] * np.array([x["n"] for x in s], np.int64)))
        won = _answer(postings, asked, n_docs, n_words, len(number), k, shard_places)
        won = won.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGE)))
        for by in (["q", "part"], ["q"]):
            w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("id"))
            won = won.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        named = spark.createDataFrame([(i, x) for i, x in enumerate(names)], f"q int, item {kinds['item'].simpleString()}")
        block_rows = written(won.join(named, "q").select("item", "rank", "id", "score"), "ranked")
        discard(postings)
        out = block_rows if out is None else out.unionByName(block_rows)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").cast(kinds["id"]).alias(id_col), "score")
