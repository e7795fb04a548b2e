"""Toxicity by non-negative positive-unlabelled learning, in numpy."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_map, discard, written

_WORD = re.compile(r"\w+")
#: Bounds of the fit: rows of confirmed toxic examples, rows of unlabelled text, features. They bound the driver's memory.
MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 3000, 6000, 20_000


def features(text: str) -> set[str]:
    """Lower-case words, and as ^x the first four and five letters of longer ones (inflected and compound forms)."""
    words = set(_WORD.findall(text.lower()))
    return words.union(["^" + w[:4] for w in words if len(w) > 4], ["^" + w[:5] for w in words if len(w) > 5])


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    prior: float

    def score(self, text: str) -> float:
        w = self.weights
        z = self.bias + sum([w[f] for f in features(text) if f in w])
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of logits of positives and of unlabelled texts, and the step's slopes by each logit.

    Risk = prior * E_positive[loss(+)] + max(0, negative), negative = E_unlabelled[loss(-)] - prior * E_positive[loss(-)],
    loss logistic. Where negative is below zero (the model knows the unlabelled positives by heart) the slopes are those
    of -negative, which lead back.
    """
    n_p, n_u = len(zp), len(zu)
    sp, su = 1 / (1 + np.exp(-np.clip(zp, -60, 60))), 1 / (1 + np.exp(-np.clip(zu, -60, 60)))
    negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
    positive = prior * np.mean(np.logaddexp(0, -zp))
    if negative >= 0:
        return positive + negative, (prior * (sp - 1) - prior * sp) / n_p, su / n_u
    return positive, prior * sp / n_p, -su / n_u


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_features: int, prior: float, *, steps: int = 300, rate: float = 0.1, shrink: float = 1e-3) -> tuple[np.ndarray, float]:
    """(weights, bias) of a sparse logistic model that minimises risk(); a text is given by its features' numbers.

    An L1 step keeps chance features at zero, so long texts gather no noise.
    """
    if not positive or not unlabelled:
        return np.zeros(n_features), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    n_p, n_u = len(positive), len(unlabelled)

    def sparse(side: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(side)), list(map(len, side))), np.concatenate(side).astype(np.int64)

    (rp, cp), (ru, cu) = sparse(positive), sparse(unlabelled)
    w, bias = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        zp = bias + np.bincount(rp, w[cp], n_p) if len(rp) else np.full(n_p, bias)
        zu = bias + np.bincount(ru, w[cu], n_u) if len(ru) else np.full(n_u, bias)
        _, gp, gu = risk(zp, zu, prior)
        g = np.bincount(cp, gp[rp], len(w)) + np.bincount(cu, gu[ru], len(w))
        gb = gp.sum() + gu.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w = w - a * m / (np.sqrt(v) + 1e-8)
        w = np.sign(w) * np.maximum(0, np.abs(w) - a * shrink)
        bias -= a * mb / (np.sqrt(vb) + 1e-8)
    return w, float(bias)


def _features(texts: DataFrame) -> DataFrame:
    """(p, f): the features of every text of (p, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = sorted(features(x.as_py() or ""))
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(own), pa.int32()), pa.array(own, pa.string())], names=["p", "f"])

    return arrow_map(texts.select("p", "text"), run, "p int, f string")


def chosen_features(texts: DataFrame, n_p: int, n_u: int, max_features: int) -> list[str]:
    """Features that 3 positives or more hold, and positives clearly more often than unlabelled texts, of (p, text).

    Counted on Spark; the driver gets max_features names at most, those of the largest z score.
    """
    c = _features(texts).groupBy("f").agg(F.sum("p").alias("a"), F.sum(1 - F.col("p")).alias("b")).where("a >= 3")
    a, b = (F.col("a") + 0.5) / (n_p + 1), (F.col("b") + 0.5) / (n_u + 1)
    z = (F.log(a) - F.log(b)) / F.sqrt((1 - a) / (F.col("a") + 0.5) + (1 - b) / (F.col("b") + 0.5))
    best = c.withColumn("z", z).where("z > 3").orderBy(F.desc("z"), "f").limit(max_features)
    return sorted(r["f"] for r in best.select("f").collect())


def _numbered(texts: DataFrame, names: list[str]) -> DataFrame:
    """(p, x): the numbers of each text's chosen features."""
    number = {f: i for i, f in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(number[f] for f in features(x.as_py() or "") if f in number) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], names=["p", "x"])

    return arrow_map(texts.select("p", "text"), run, "p int, x array<int>")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES) -> Model:
    """Fit on confirmed toxic documents (label 1) and on unlabelled text (any document), both bounded samples.

    The class prior is the share of label 1 among the labels given. Rows are drawn by hash of the id, so the sample is
    the same on every run and covers the whole table. Labels that are null, or whose id is null or absent, are ignored;
    of repeated ids the highest label counts, and of their texts the first in order. Features are counted and chosen on
    Spark; the driver gets the chosen ones' numbers for each text of the samples, never a text.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    n, n_pos = known.agg(F.count("*"), F.sum(F.col("y").cast("long"))).first()
    n_pos = n_pos or 0
    prior = min(max(n_pos / n if n else 0.05, 1e-3), 0.5)
    # thin by hash to about the sample's size, then take the exact number by hash order
    draw = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    pos_ids = known.where("y = 1").where(draw < min(1.0, 1.3 * max_positive / max(n_pos, 1))).orderBy(F.xxhash64("id", F.lit(17))).limit(max_positive).select("id")
    total = docs.count()
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    some = text.where(draw < min(1.0, 1.3 * max_unlabelled / max(total, 1))).select("id").distinct()
    u_ids = [r[0] for r in some.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(max_unlabelled).collect()]
    ids = [r[0] for r in pos_ids.collect()]
    if not ids or not u_ids:
        return Model({}, fit_nnpu([], [], 0, prior)[1], prior)
    # one scan for both samples; only ids go through the driver
    taken = text.where(F.col("id").isin(sorted({*ids, *u_ids}))).groupBy("id").agg(F.min("text").alias("text"))
    as_p, as_u = F.when(F.col("id").isin(ids), 1), F.when(F.col("id").isin(u_ids), 0)
    both = written(taken.select(F.explode(F.array_compact(F.array(as_p, as_u))).alias("p"), "text"), "training")
    n_p, n_u = both.agg(F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum(1 - F.col("p")), F.lit(0))).first()
    names = chosen_features(both, n_p, n_u, max_features)
    t = _numbered(both, names).toArrow()
    side = lambda k: [np.array(x, np.int64) for x, p in zip(t.column("x").to_pylist(), t.column("p").to_pylist()) if p == k]
    w, bias = fit_nnpu(side(1), side(0), len(names), prior)
    discard(both)
    return Model({f: float(x) for f, x in zip(names, w) if x}, bias, prior)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the id column, the columns in keep, score (0 to 1) and predicted (1 from threshold on).

    Every whole text is scored; null counts as empty. Null ids and repeated rows stay as they are. Map-only.
    """
    used = docs.select(id_col, text_col, *[c for c in keep if c not in (id_col, text_col)])
    send = [c for c in used.columns if c in (id_col, *keep)]
    schema = ", ".join(f"`{c}` {used.schema[c].dataType.simpleString()}" for c in send) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [model.score(x.as_py() or "") for x in batch.column(1)]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in send]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=[*send, "score", "predicted"])

    return arrow_map(used, run, schema)


def learn_part(id_col: str = "doc_id"):
    """Rows whose labels may be learnt: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1
