"""Kernels per key over sorted partitions: no data frame per group, small groups share tasks, a large one is numbers alone."""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import on_workers

_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
#: Rows that are handed back at a time.
ROWS = 20_000
#: Tasks that kernels are dealt to, by cores. More of them even out sizes, but each starts at a cost.
TASKS_A_CORE = 3


def by_key(df: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """kernel(*columns) of the rows of each value in df's first column, behind that value.

    All columns of df are longs without nulls. The kernel gets the others as arrays and gives columns back, one for
    each but the first of the schema. Rows are dealt by key to some tasks a core, which adaptive execution does not merge:
    kernels take time that their bytes don't tell.
    """
    on_workers(df.sparkSession)
    fields = [x.split() for x in schema.split(", ")]
    arrow = pa.schema([pa.field(name, _TYPES[kind]) for name, kind in fields])
    key = df.columns[0]

    def batch(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches):
        told: list[list] = [[] for _ in arrow]

        def close(k: int, parts: list):
            nonlocal told
            got = kernel(*(parts[0] if len(parts) == 1 else [np.concatenate(c) for c in zip(*parts)]))
            n = len(got[0])
            if n + len(told[0]) > ROWS and told[0]:
                yield batch(told)
                told = [[] for _ in arrow]
            if n > ROWS:
                for at in range(0, n, ROWS):
                    yield batch([[k] * min(ROWS, n - at), *(c[at : at + ROWS] for c in got)])
            elif n:
                told[0] += [k] * n
                for have, more in zip(told[1:], got):
                    have.extend(more)

        held, parts = None, []
        for b in batches:
            keys, *columns = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(keys):
                continue
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                k = int(keys[lo])
                if k != held:
                    if parts:
                        yield from close(held, parts)
                    held, parts = k, []
                parts.append([c[lo:hi] for c in columns])
        if parts:
            yield from close(held, parts)
        if told[0]:
            yield batch(told)

    tasks = TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, key).sortWithinPartitions(key).mapInArrow(run, schema)


def packed(x) -> array:
    """Whole numbers, eight bytes each, that give Python's own numbers."""
    out = array("q")
    out.frombytes(np.ascontiguousarray(x, np.int64).tobytes())
    return out


def filled(n: int, value: int) -> array:
    return array("q", [value]) * n


def adjacency(seg: np.ndarray, idx: np.ndarray, a: np.ndarray, ea: np.ndarray, b: np.ndarray, eb: np.ndarray) -> tuple[array, array, array]:
    """(start, other, number): what links join to each side, by their numbers.

    Sides are numbered 2 * place of the segment in seg (sorted) + end, 0 left and 1 right. The links of side s stand from
    start[s] to start[s + 1]; a link of a side with itself stands once.
    """
    order = np.lexsort((eb, b, ea, a, idx))
    x, y = (2 * np.searchsorted(seg, v[order]) + e[order] for v, e in ((a, ea), (b, eb)))
    apart, number = x != y, idx[order]
    side, other, number = (np.concatenate(p) for p in ((x, y[apart]), (y, x[apart]), (number, number[apart])))
    rank = np.concatenate((np.arange(len(x)), np.flatnonzero(apart)))
    by = np.lexsort((rank, side))
    start = np.concatenate(([0], np.cumsum(np.bincount(side, minlength=2 * len(seg)))))
    return packed(start), packed(other[by]), packed(number[by])
