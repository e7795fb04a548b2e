"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

A round takes the documents of a range of lengths, the longest first, and the gaps that may hold them. Both are
range-sorted by size and dealt by their rank in their range, so that each sweep gets its even share of every size and no
two sweeps want the same gap. A sweep goes from large to small and gives each document its successor among the gaps (the
smallest that holds it), by rank where several want one, and a new sequence where none does. What is left of the gaps
goes to the next round.
"""

from __future__ import annotations

import heapq
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, written
from .bpe import CACHE_ENTRIES, Vocabulary, batches_of_chunks, joined_ids

CAPACITY = 4096
END_ID = 1
#: Documents whose distinct chunks are encoded together.
BATCH_ROWS = 8000
#: A round holds lengths of over capacity / 2, one of over capacity / 4, and so on; the last all that are left.
ROUNDS = 7
#: Documents and gaps of a sweep. Each sweep may leave a sequence of its own that is not full.
SWEEP_ROWS = 10_000


_BY_PATH: dict[tuple[str, int], Vocabulary] = {}


def _vocabulary(path: str, entries: int = CACHE_ENTRIES) -> Vocabulary:
    """The process's ids by the tokenizers library, which encodes each chunk once."""
    if (path, entries) not in _BY_PATH:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()

        def encode_many(texts: list[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for at in range(0, len(texts), 5000) for e in tok.encode_batch_fast(texts[at : at + 5000], add_special_tokens=False)]

        _BY_PATH[path, entries] = Vocabulary(encode_many, entries)
    return _BY_PATH[path, entries]


def pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False, batch_rows: int = BATCH_ROWS, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document: its ids and end_id, cut only beyond capacity.

    Fewer batch_rows and cache_entries take less memory and more time, and change nothing else. A null text counts as empty and gives one piece that holds end_id alone.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path, cache_entries)
        for batch in batches:
            take, piece, start, length, crc, all_ids = [], [], [], [], [], []
            i = -1
            for offsets, codes, chunks in batches_of_chunks(batch.column(1), batch_rows):
                tokens, at = joined_ids(vocabulary.of(chunks), codes)
                for x, y in zip(at[offsets[:-1]].tolist(), at[offsets[1:]].tolist()):
                    i += 1
                    raw = tokens[x:y].tobytes() + end
                    n = len(raw) // 4
                    for k, a in enumerate(range(0, n, capacity)):
                        b = min(n, a + capacity)
                        take.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                        if ids:
                            all_ids.append(np.frombuffer(raw, "<u4")[a:b].astype("int32"))
            cols = [batch.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if ids:
                cols, names = [*cols, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if ids else ""))


class Sweep:
    """Documents and gaps from large to small, gaps first of equals; each document goes to the smallest gap that holds it."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.fresh = capacity, first_id
        self.open: list[tuple[int, int]] = []  # (gap, sequence) that hold what comes next, the smallest last
        self.rest: list[tuple[int, int]] = []  # a heap of (-gap, sequence): too small yet

    def _reach(self, size: int) -> None:
        while self.rest and -self.rest[0][0] >= size:
            gap, seq = heapq.heappop(self.rest)
            self.open.append((-gap, seq))

    def gap(self, size: int, seq: int) -> None:
        self._reach(size)
        self.open.append((size, seq))

    def document(self, size: int) -> tuple[int, int]:
        """(sequence, offset)"""
        self._reach(size)
        if self.open:
            gap, seq = self.open.pop()
        else:
            gap, seq = self.capacity, self.fresh
            self.fresh += 1
        left = gap - size
        if left >= size:
            self.open.append((left, seq))
        elif left:
            heapq.heappush(self.rest, (-left, seq))
        return seq, self.capacity - gap

    def gaps(self) -> list[tuple[int, int]]:
        return self.open + [(-g, seq) for g, seq in self.rest]


def _dealt(rows: DataFrame, sweeps: int) -> DataFrame:
    """Range-sorted by size; the n-th document and the n-th gap of a range go to sweep n modulo their number."""
    order = (F.col("size").desc(), F.col("gap").desc(), F.col("tie"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [TaskContext.get().partitionId()] * 2
        for batch in batches:
            gap = batch.column(batch.schema.get_field_index("gap")).to_numpy(zero_copy_only=False).astype(bool)
            sweep = np.empty(len(gap), np.int64)
            for k, mine in enumerate((gap, ~gap)):
                n = int(mine.sum())
                sweep[mine] = (seen[k] + np.arange(n)) % sweeps
                seen[k] += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sweep)], names=[*batch.schema.names, "sweep"])

    return arrow_map(ranged, run, fields + ", sweep long")


def _swept(dealt: DataFrame, capacity: int, number: int) -> DataFrame:
    """(gap, sequence_id, offset, row) of a round: documents with their places, and gaps (gap not null) as they are after it."""
    kind = dealt.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sweep, row_type = None, None, None

        def left() -> pa.RecordBatch:
            gaps = sweep.gaps() if sweep else []
            cols = [pa.array([g for g, _ in gaps], pa.int64()), pa.array([s for _, s in gaps], pa.int64()), pa.nulls(len(gaps), pa.int64()), pa.nulls(len(gaps), row_type)]
            return pa.RecordBatch.from_arrays(cols, names=["gap", "sequence_id", "offset", "row"])

        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))
            row_type = get("row").type
            take, seqs, offsets = [], [], []
            for i, (which, size, gap, seq) in enumerate(zip(*(get(c).to_pylist() for c in ("sweep", "size", "gap", "seq")))):
                if which != now:
                    if sweep:
                        yield left()
                    now, sweep = which, Sweep(capacity, number << 56 | which << 24)
                if gap:
                    sweep.gap(size, seq)
                else:
                    s, o = sweep.document(size)
                    take.append(i)
                    seqs.append(s)
                    offsets.append(o)
            rows = get("row").take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(take), pa.int64()), pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64()), rows], names=["gap", "sequence_id", "offset", "row"])
        if sweep:
            yield left()

    return arrow_map(dealt, run, f"gap long, sequence_id long, offset long, row {kind}")


def pack(rows: DataFrame, *, id_col: str = "doc_id", capacity: int = CAPACITY, rounds: int = ROUNDS, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """rows of pieces() with sequence_id and offset added. rows is read once a round: give a table that is written.

    Every piece has one place; no two overlap, and each sequence is filled from 0 without gaps. Equal rows get places
    of their own. An empty table gives an empty one. Pieces of no length or longer than capacity raise ValueError. A
    round's table is written before the next one; the driver sees the rounds' counts alone. With one sweep a round the
    result is what best-fit decreasing gives row by row.
    """
    bounds = [capacity >> k for k in range(1, rounds) if capacity >> k] + [0]  # a round holds what is longer
    tie = F.xxhash64(id_col, "piece", "ids_crc32", "start")
    docs = rows.select(F.col("length").cast("long").alias("size"), F.lit(False).alias("gap"), tie.alias("tie"), F.lit(0).cast("long").alias("seq"), F.struct(*rows.columns).alias("row"))
    number = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= F.col("size")))
    counts = {r["k"]: r for r in docs.groupBy(number.alias("k")).agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most")).collect()}
    for r in counts.values():
        if r["least"] < 1 or r["most"] > capacity:
            raise ValueError(f"lengths of {r['least']} to {r['most']}")
    done: list[DataFrame] = []
    above = capacity
    for k, low in enumerate(bounds):
        if k in counts:
            # what a round left that was too small for the rounds since, and all that the last one left
            gaps = [t.where(F.col("gap") > low) if t is done[-1] else t.where((F.col("gap") > low) & (F.col("gap") <= above)) for t in done]
            gaps = [t.select(F.col("gap").alias("size"), F.lit(True).alias("gap"), F.xxhash64("sequence_id").alias("tie"), F.col("sequence_id").alias("seq"), F.lit(None).cast(docs.schema["row"].dataType).alias("row")) for t in gaps]
            n = sum(t.count() for t in gaps)
            both = docs.where((F.col("size") > low) & (F.col("size") <= (bounds[k - 1] if k else capacity)))
            for t in gaps:
                both = both.unionByName(t)
            sweeps = -(-max(n, counts[k]["n"]) // sweep_rows)
            dealt = _dealt(both, sweeps).repartition("sweep").sortWithinPartitions("sweep", F.col("size").desc(), F.col("gap").desc(), "tie")
            done.append(written(_swept(dealt, capacity, k), f"round{k}"))
            above = low
    if not done:
        return rows.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = done[0]
    for t in done[1:]:
        out = out.unionByName(t)
    return out.where("gap IS NULL").select(*[F.col("row").getField(c).alias(c) for c in rows.columns], "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, batch_rows: int = BATCH_ROWS, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """pieces() written to the shared folder, then pack()."""
    return pack(written(pieces(docs, path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, batch_rows=batch_rows, cache_entries=cache_entries), "pieces"), id_col=id_col, capacity=capacity)
