"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Indicators are the presence of words, and of one- to three-word runs of word shapes (runs of lower-case letters, capitals,
digits and single other characters), each also by the share of the text that it makes up; and how often words repeat
just after themselves. Every indicator is scaled by the log ratio of its smoothed counts in the two classes; on these,
a linear model with squared hinge loss is fitted by dual coordinate descent; a logistic curve turns margins into
probabilities. Fitting takes a bounded sample of labelled rows (FIT_ROWS, those whose id hashes lowest); scoring
covers every row, where it lies, without a shuffle.

Null counts as empty text; an empty text has no indicators and scores as the model's intercept says. Without labels, or
with labels of one class, all rows score that class's share (0.5 without any). Labels that contradict each other for an
id, or are null, are not used. Repeated rows score alike. Other columns pass through; those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import textvec
from .common import small_batches

U = np.uint64
#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 20_000
BITS = 18
#: Shares of a text from which a shape counts as frequent, very frequent, and so on.
SHARES = (0.002, 0.01, 0.04, 0.15)
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[[9, 11, 12, 13]] = ord(" ")


def feature_rows(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct indicator numbers of each row."""
    words, word_at = textvec.word_hashes(data, offsets)
    shape = _SHAPE[data]
    firsts = np.zeros(len(data) + 1, bool)
    firsts[offsets] = True
    kept = firsts[:-1].copy()
    kept[1:] |= shape[1:] != shape[:-1]
    short = np.r_[0, np.cumsum(kept)][offsets]
    shapes, shape_at = textvec.word_hashes(shape[kept], short, lower=False)
    repeats = [np.r_[np.zeros(d, bool), words[d:] == words[:-d]] if len(words) > d else np.zeros(len(words), bool) for d in (1, 2, 3)]
    runs = [shapes]
    for k in (2, 3):
        more = textvec.mix(runs[-1][:-1] * U(3) + shapes[k - 1 :] + U(k)) if len(runs[-1]) > 1 else np.zeros(0, U)
        runs.append(more)
    mask = U((1 << BITS) - 1)
    for i in range(len(offsets) - 1):
        a, b, c, d = word_at[i], word_at[i + 1], shape_at[i], shape_at[i + 1]
        found = [textvec.mix(np.unique(words[a:b]))]
        for k, run in enumerate(runs):
            keys, n = np.unique(run[c : max(c, d - k)], return_counts=True)
            found.append(keys)
            for j, share in enumerate(SHARES):
                found.append(textvec.mix(keys[n >= share * (d - c)] + U(101 + j)))
        if b > a:
            for j, again in enumerate(repeats):
                share = again[a + j + 1 : b].sum() / (b - a)
                found += [np.array([textvec.mix(np.array([1000 + 10 * j + s], U))[0]]) for s, least in enumerate((0.02, 0.1, 0.3)) if share >= least]
        yield np.unique(np.concatenate(found) & mask).astype(np.int32)


@dataclass
class Model:
    """Weights already scaled by the log ratios."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum() / np.sqrt(max(1, len(features)))) + self.bias

    def score(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def constant(share: float) -> Model:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share))))


def fit(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7) -> Model:
    """labels: 0 or 1. Rows are scaled to unit length before the log ratios apply."""
    if not len(rows) or labels.min() == labels.max():
        return constant(float(labels.mean()) if len(rows) else 0.5)
    sums = [np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == k]), minlength=1 << BITS) + 1.0 for k in (0, 1)]
    ratio = np.log(sums[1] / (2 + (labels == 1).sum())) - np.log(sums[0] / (2 + (labels == 0).sum()))
    fold = np.arange(len(rows)) % 5 == 0  # for the logistic curve, so that it isn't fitted on fitted margins
    if len(np.unique(labels[fold])) < 2 or len(np.unique(labels[~fold])) < 2:
        fold = np.zeros(len(rows), bool)
    y = np.where(labels == 1, 1.0, -1.0)
    scale = np.array([1 / np.sqrt(max(1, len(r))) for r in rows])
    norm = np.array([(ratio[r] ** 2).sum() for r in rows]) * scale**2
    weigh = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * c
    weights, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    generator = np.random.default_rng(seed)
    train = np.flatnonzero(~fold)
    for _ in range(epochs):
        moved = 0.0
        for i in generator.permutation(train):
            r = rows[i]
            soft = 1 / (2 * weigh[i])
            slope = y[i] * ((weights[r] * ratio[r]).sum() * scale[i] + bias) - 1 + soft * alpha[i]
            new = max(0.0, alpha[i] - slope / (norm[i] + 1 + soft))
            if step := new - alpha[i]:
                weights[r] += step * y[i] * scale[i] * ratio[r]
                bias += step * y[i]
                alpha[i], moved = new, max(moved, abs(step))
        if moved < 1e-3:
            break
    model = Model(weights * ratio, bias, 1.0, 0.0)
    held = np.flatnonzero(fold) if fold.any() else train
    margins, truth = np.array([model.margin(rows[i]) for i in held]), labels[held]
    high, low = (truth.sum() + 1) / (truth.sum() + 2), 1 / ((1 - truth).sum() + 2)
    target = np.where(truth == 1, high, low)
    at = np.array([1.0, 0.0])
    for _ in range(60):  # Newton steps with a little ridge
        p = 1 / (1 + np.exp(-np.clip(at[0] * margins + at[1], -30, 30)))
        w = p * (1 - p)
        gradient = np.array([((p - target) * margins).sum(), (p - target).sum()]) + 1e-3 * at
        hessian = np.array([[(w * margins**2).sum(), (w * margins).sum()], [(w * margins).sum(), w.sum()]]) + 1e-3 * np.eye(2)
        at = at - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    model.slope, model.offset = float(max(at[0], 1e-3)), float(at[1])
    return model


def features(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the indicators as binary int32."""
    small_batches(docs.sparkSession)
    source = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r.tobytes() for _, _, data, offsets in textvec.chunks(batch.column(len(keep))) for r in feature_rows(data, offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.binary())], names=[*keep, "features"])

    return source.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", features binary")


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """Fits on at most ``fit_rows`` labelled rows outside the held-out fold."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__label"), F.max(label_col).alias("__most"))
    known = known.where((F.col("__label") == F.col("__most")) & ~held_out("__id"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows).select("__id", "__label")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t")).join(F.broadcast(sample), "__id")  # fit_rows rows at most
    found = sorted((r["__id"], r["__label"], r["features"]) for r in features(rows, "__t", ["__id", "__label"]).collect())
    return fit([np.frombuffer(x[2], np.int32) for x in found], np.array([x[1] for x in found], np.int64))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # 2**BITS weights, whatever the data's size
    rows = docs.drop("score")
    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = sent.value
        for batch in batches:
            scores = [tool.score(tool.margin(r)) for _, _, data, offsets in textvec.chunks(batch.column(at)) for r in feature_rows(data, offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return rows.mapInArrow(run, schema)
