"""Substring dedup: content-defined chunks find what may repeat, digests of whole word windows what does.

A gear hash rolls over a text's words: with every word it moves up and takes the word's own number, so that it depends on
the last few words alone. A chunk ends where the hash is the least of a window of places. Chunks are deduplicated by digest:
each is known by the document of smallest id that holds it. Chunks in a row with one such document, at places that lie as
far apart there, are a run that this document holds as a whole. Only windows of words that no run covers are digested
themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_map, discard, written
from .shingles import mix

MIN_WORDS = 50
#: A border of words stands where the hash of so many words is the least of a window of places; see window_of().
SPAN = 3
#: Bits of a place's hash.
GEAR_BITS = 33
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.where(_BLANK, np.uint64(0), mix(np.arange(1, 257, dtype=np.uint64)))
_POWER = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64))


def gear(words: np.ndarray, span: int) -> np.ndarray:
    """The rolling hash after each word from the span-th on: h = (h << shift) + GEAR[word] modulo 2 ** GEAR_BITS.

    words: a 64-bit hash of each word; its number in the gear table is a further mix of it, as a table of all words cannot
    be held. The shift is such that a word has left the hash after span words.
    """
    shift = -(-GEAR_BITS // span)
    number = mix(words) >> np.uint64(64 - GEAR_BITS)
    n = len(words) - span + 1
    h = np.zeros(n, np.uint64)
    for k in range(span):
        h = (h << np.uint64(shift)) + number[k : k + n]
    return h & np.uint64((1 << GEAR_BITS) - 1)


def _least(key: np.ndarray, window: int) -> np.ndarray:
    """The least of each window of keys."""
    least, span = key, 1
    while span * 2 <= window:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < window:
        n = len(key)
        least = np.minimum(least[: n - window + 1], least[window - span : n - span + 1])
    return least


def window_of(min_words: int) -> tuple[int, int]:
    """(words hashed, places compared) such that any min_words words, however short, decide two borders by themselves."""
    if min_words < 2:
        raise ValueError("min_words must be 2 at least")
    span = min(SPAN, min_words - 1)
    return span, (min_words - span + 1) // 2


def word_borders(data: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(starts, ends, least, chosen) of one text's bytes; None where it has fewer than min_words words.

    starts and ends: of words, in bytes. least: per window of places the word that is its border (the first of equals).
    chosen: those words, each once. The words i to i + min_words - 1 hold the places whose windows are i to
    i + min_words - span + 1 - window, so least of the first and last of these are borders wherever those words stand,
    and so are all between; the two windows share no place, so there is a whole chunk between them.
    """
    blank = _BLANK[data]
    begins = ~blank
    stops = begins.copy()
    begins[1:] &= blank[:-1]
    starts = np.flatnonzero(begins)
    if len(starts) < min_words:
        return None
    stops[:-1] &= blank[1:]
    ends = np.flatnonzero(stops) + 1
    at = starts[0]
    offset = np.arange(at, len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    word = mix(np.add.reduceat(_BYTE[data[at:]] * _POWER[offset & 1023], starts - at))
    span, window = window_of(min_words)
    h = gear(word, span)
    # a text of Spark's greatest size, 2 GB, has fewer words than the places that 31 bits tell apart
    key = h << np.uint64(64 - GEAR_BITS) | np.arange(len(h), dtype=np.uint64)
    least = (_least(key, window) & np.uint64((1 << (64 - GEAR_BITS)) - 1)).astype(np.int64)
    return starts, ends, least, least[np.append(True, least[1:] != least[:-1])]


def _of(x: pa.Scalar, min_words: int) -> tuple | None:
    buf = x.as_buffer() if x.is_valid else b""
    if len(buf) < 2 * min_words - 1:
        return None
    got = word_borders(np.frombuffer(buf, np.uint8), min_words)
    return got and (memoryview(buf), *got)


def _digests(view: memoryview, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    own = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)
    return own.view(np.int64)


def _batch(batch: pa.RecordBatch, names: list[str], take: list, *columns: list) -> pa.RecordBatch:
    joined = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)) for x in (take, *columns)]
    return pa.RecordBatch.from_arrays([batch.column(0).take(joined[0]), *joined[1:]], names=["id", *names])


def _rows(batches: Iterator[pa.RecordBatch], names: list[str], of_row, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """The columns that of_row(batch, i) returns (or None) for each row, with its id, in batches of about `most` rows."""
    for batch in batches:
        cols, held = [[] for _ in range(len(names) + 1)], 0
        for i in range(batch.num_rows):
            got = of_row(batch, i)
            if got is None:
                continue
            for c, x in zip(cols, (np.full(len(got[0]), i), *got)):
                c.append(x)
            held += len(got[0])
            if held > most:
                yield _batch(batch, names, *cols)
                cols, held = [[] for _ in range(len(names) + 1)], 0
        yield _batch(batch, names, *cols)


def _back(starts: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """How far before each start stands the text's first one with the same digest."""
    _, lead, which = np.unique(digest, return_index=True, return_inverse=True)
    return starts - starts[lead[which]]


def chunks(docs: DataFrame, *, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, digest, pos, back) of every chunk between two borders of every whole text of min_words words.

    pos packs start << 32 | number of its first word, start in bytes of UTF-8; back: how far before stands the text's first
    chunk of this digest.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def of_row(batch: pa.RecordBatch, i: int) -> tuple | None:
        got = _of(batch.column(1)[i], min_words)
        if got is None:
            return None
        view, starts, _, _, chosen = got
        a = starts[chosen[:-1]]
        digest = _digests(view, a, starts[chosen[1:]])
        return digest, a << 32 | chosen[:-1], _back(a, digest)

    return arrow_map(docs.select(id_col, text_col), lambda b: _rows(b, ["digest", "pos", "back"], of_row), f"id {kind}, digest long, pos long, back long")


def runs_and_windows(docs: DataFrame, *, min_words: int) -> DataFrame:
    """(id, digest, pos, size, back, words): runs of chunks, and every window that no run covers but whose chunks are all hits.

    docs: id, text, hits, again. hits: (pos, f, fs) of the chunks that another document holds too, f the smallest id that
    holds one, fs where it first stands there; again: other rows have this id, so that some hits may be of their texts. pos packs start << 32 | number of the first word; start and size in bytes of UTF-8. Of a
    run words is the number of its words, digest the id that holds it and back how much later it stands here; of a window
    words is 0 and back is how far before stands the text's first such window. A run has min_words words or more and is
    held by a smaller id. The smallest id that holds a window has no run over it, so it has a row for it.
    """
    span, window = window_of(min_words)
    far = min_words - span + 1 - window

    def of_row(batch: pa.RecordBatch, i: int) -> tuple | None:
        got = _of(batch.column(1)[i], min_words)
        if got is None:
            return None
        view, starts, ends, least, chosen = got
        own, hits = batch.column(0)[i].as_py(), batch.column(2)[i].values
        pos, f, fs = (hits.field(k).to_numpy() for k in ("pos", "f", "fs"))
        if batch.column(3)[i].as_py():  # hits of all texts of an id that repeats: where they may stand here, and no runs
            f = np.full(len(f), own)
        at = np.searchsorted(chosen[:-1], pos & 0xFFFFFFFF)
        here = np.append(chosen[:-1], -1)[at] == pos & 0xFFFFFFFF
        at, pos, f, fs = at[here], pos[here], f[here], fs[here]
        holder, shift = np.zeros(len(chosen), np.int64), np.zeros(len(chosen), np.int64)
        is_hit = np.zeros(len(chosen), bool)  # the last place is no chunk
        is_hit[at], holder[at], shift[at] = True, f, fs - (pos >> 32)
        new = ~(is_hit[1:] & is_hit[:-1] & (holder[1:] == holder[:-1]) & (shift[1:] == shift[:-1]))
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(chosen)]])
        lo, hi = cuts[:-1], np.minimum(cuts[1:], len(chosen) - 1)
        long = is_hit[lo] & (holder[lo] != own) & (chosen[hi] - chosen[lo] >= min_words)
        a, b, r = chosen[lo[long]], chosen[hi[long]], lo[long]
        missing = np.append(0, np.cumsum(~is_hit[:-1]))
        place = np.cumsum(np.append(0, least[1:] != least[:-1]))  # of least in chosen
        full = missing[place[far:]] == missing[place[: len(place) - far]]
        covered = np.zeros(len(full) + 1, np.int64)
        np.add.at(covered, a, 1)
        np.add.at(covered, b - min_words + 1, -1)
        first = np.flatnonzero(full & (np.cumsum(covered)[:-1] == 0))
        if not len(first) and not len(a):
            return None
        s, e = starts[first], ends[first + min_words - 1]
        digest = _digests(view, s, e)
        join = np.concatenate
        return (
            join([holder[r], digest]), join([starts[a] << 32 | a, s << 32 | first]), join([ends[b - 1] - starts[a], e - s]),
            join([-shift[r], _back(s, digest) if len(s) else s]), join([b - a, np.zeros(len(first), np.int64)]),
        )

    return arrow_map(docs.select("id", "text", "hits", "again"), lambda b: _rows(b, ["digest", "pos", "size", "back", "words"], of_row), "id long, digest long, pos long, size long, back long, words long")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Passages of at least min_words words that stand in a document of smaller id too.

    A row per passage: the id column, start and end (bytes of the UTF-8 text, end exclusive, on borders of words),
    n_words, first_id and first_start (where the same bytes stand before). Rows of one document may overlap; see
    merged_spans(). Every window of min_words words that an earlier document holds is in a row; its partner is the
    document of smallest id with that window, so one copy always stays. Repeats within one document alone are left. The
    id must be an integer; null ids and null or short texts have no passages; of an id that repeats with different texts
    any row's text may be compared. Words are set apart by ASCII white space.

    Whatever two documents share of min_words words holds a chunk with the same borders in both. Chunks meet by a 64-bit
    digest of all their bytes, which tells the first document and place of each. A run of chunks that one document holds
    in a row is held by no smaller one, so its windows need no digests; the others whose chunks all stand in two
    documents meet by theirs. Partial minima find each digest's first place, and joins whose hot digests can be split
    bring it back. Windows one word apart with the same first document and shift become one row.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    start, number = F.shiftright("pos", 32), F.col("pos").bitwiseAND(F.lit(0xFFFFFFFF))
    # least id with its place: plain numbers, so that partial results are kept by hash and not sorted
    lead = (start - F.col("back")).alias("lead")
    firsts = lambda x: x.select("id", "digest", lead).groupBy("digest").agg(F.min("id").alias("f"), F.min_by("lead", "id").alias("fs"), F.max("id").alias("m")).where("f < m").select("digest", "f", "fs")
    c = written(chunks(rows, id_col="id", text_col="text", min_words=min_words), "chunks")
    shared = written(firsts(c), "shared")
    hits = written(c.select("id", "digest", "pos").join(shared, "digest").groupBy("id").agg(F.collect_list(F.struct("pos", "f", "fs")).alias("hits")), "hits")
    twice = written(rows.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("again")), "repeated_ids")
    hits_of = hits.join(twice, "id", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    discard(c, shared)
    w = written(runs_and_windows(rows.join(hits_of, "id"), min_words=min_words), "windows")
    discard(hits, twice)
    alone = w.where("words = 0")
    first = written(firsts(alone), "firsts")
    hit = alone.select("id", "digest", "pos", "size").join(first, "digest").where("id <> f").select("id", start.alias("s"), (start + F.col("size")).alias("e"), number.alias("k"), number.alias("last"), "f", "fs")
    run = w.where("words > 0").select("id", start.alias("s"), (start + F.col("size")).alias("e"), number.alias("k"), (number + F.col("words") - min_words).alias("last"), F.col("digest").alias("f"), (start - F.col("back")).alias("fs"))
    # windows and runs of one document one word apart with the same first document and shift are one passage
    per_doc = Window.partitionBy("id").orderBy("k", "s", "f", "fs")
    joins = (F.col("k") - F.lag("last").over(per_doc) <= 1) & (F.lag("f").over(per_doc) == F.col("f")) & (F.lag(F.col("fs") - F.col("s")).over(per_doc) == F.col("fs") - F.col("s"))
    runs = hit.unionByName(run).withColumn("new", F.when(joins, 0).otherwise(1)).withColumn("run", F.sum("new").over(per_doc))
    runs = runs.groupBy("id", "run").agg(F.min("s").alias("start"), F.max("e").alias("end"), (F.max("last") - F.min("k") + min_words).alias("n_words"), F.min("f").alias("first_id"), F.min("fs").alias("first_start"))
    return runs.drop("run").withColumnRenamed("id", id_col)


def merged_spans(passages: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, spans): per document the union of its passages as a sorted array of start and end, in bytes."""
    spans = F.sort_array(F.collect_set(F.struct("start", "end")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    last = lambda acc: F.element_at(acc, -1)
    step = lambda acc, x: F.when((F.size(acc) > 0) & (last(acc)["end"] >= x["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x)))
    return passages.groupBy(id_col).agg(spans.alias("spans")).select(id_col, F.aggregate("spans", empty, step).alias("spans"))


def without_passages(docs: DataFrame, passages: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the passages cut out of their texts; rows, columns and their order stay.

    Spans are places in one text, so the texts of an id that repeats with different texts stay whole, as do those of null
    ids; rows of an id that repeat with one text are cut alike.
    """
    stamp = F.xxhash64(text_col)
    unsure = docs.groupBy(id_col).agg(F.min(stamp).alias("_least"), F.max(stamp).alias("_most")).where("_least <> _most").select(id_col)
    spans = merged_spans(passages, id_col=id_col).join(unsure, id_col, "left_anti").select(F.col(id_col).alias("_id"), F.col("spans").alias("_spans"))
    # docs as one struct, so that its other columns' names clash with nothing
    row = F.col("_row")
    joined = docs.select(F.struct(*docs.columns).alias("_row")).join(spans, row[id_col] == F.col("_id"), "left")
    body = row[text_col].cast("binary")
    edges = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))), F.col("_spans"))
    after = F.concat(F.transform("_spans", lambda x: x["start"]), F.array(F.octet_length(row[text_col]).cast("long")))
    kept = F.array_join(F.zip_with(edges, after, lambda a, b: body.substr((a["end"] + 1).cast("int"), (b - a["end"]).cast("int")).cast("string")), "")
    text = F.when(F.col("_spans").isNull(), row[text_col]).otherwise(kept)
    return joined.select(*[(text if c == text_col else row[c]).alias(c) for c in docs.columns])
