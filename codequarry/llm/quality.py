"""Quality classifier: hashed word n-grams, follow-the-regularised-leader, sparse dot products.

A text becomes a sparse vector of hashed tokens and token pairs. Tokens are runs of letters
and digits, or runs of other visible characters, in their own case: capitals, symbol runs
and a token that repeats itself (a pair of its own kind) all tell quality. Values are
square roots of counts, scaled to length one, so that a square is a share of the text. Weights are learned by per-coordinate
FTRL-proximal updates, one labelled document after the other, and a score is the logistic
of one sparse dot product.

Training takes a bounded sample (``sample_rows``) whose vectors are built where the texts
lie; one task then runs the updates, which are sequential by nature. Weights are at most
``2**bits`` numbers, whatever the corpus.

Defined results: a null or empty text has the empty vector and scores the logistic of the
bias. Without usable labels every text scores 0.5. Repeated rows get equal scores. Other
columns, whatever their names, are carried through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from . import text
from .training import labelled_sample

BITS = 18
SAMPLE_ROWS = 6000
THRESHOLD = 0.3
PASSES = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

_KIND = np.full(256, 2, np.uint8)
_KIND[text.SPACE] = 0
_KIND[:0x20] = 0
_KIND[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1),
       *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 1
_SAME = np.uint64(0x5DEECE66D)


def sparse_vectors(data: np.ndarray, offsets: np.ndarray, bits: int):
    """(row, index, value) of the token n-grams of every text, rows ascending."""
    starts, ends = text.token_bounds(_KIND[data], offsets)
    word = text.SpanHash(data)(starts, ends)
    first = text.per_text(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    pair = text.mixed(word[:-1] * np.uint64(3) + word[1:])
    pair[word[:-1] == word[1:]] = _SAME
    joined = row[:-1] == row[1:] if len(row) else np.zeros(0, bool)
    rows = np.concatenate([row, row[:-1][joined]])
    grams = np.concatenate([word, pair[joined]]) >> np.uint64(64 - bits)
    cells, counts = np.unique((rows.astype(np.uint64) << np.uint64(bits)) | grams, return_counts=True)
    row = (cells >> np.uint64(bits)).astype(np.int64)
    index = (cells & np.uint64((1 << bits) - 1)).astype(np.int64)
    value = np.sqrt(counts)
    norm = np.sqrt(np.bincount(row, value * value, len(offsets) - 1))
    return row, index, value / norm[row]


@dataclass(frozen=True)
class Model:
    """Weights by hashed n-gram, and the bias."""

    bits: int
    bias: float
    weights: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.empty(len(offsets) - 1)
        for a, b in text.pieces(data, offsets):
            part = offsets[a:b + 1] - offsets[a]
            row, index, value = sparse_vectors(data[offsets[a]:offsets[b]], part, self.bits)
            dot = np.bincount(row, self.weights[index] * value, b - a)
            out[a:b] = 1 / (1 + np.exp(-(dot + self.bias)))
        return out


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], size: int, passes: int = PASSES):
    """Weights and bias after ``passes`` rounds of FTRL-proximal over the examples.

    The last cell of the state is the bias, which is not pulled to zero."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, L1)
    l1[size] = 0

    def weight(i):
        shrunk = np.sign(z[i]) * np.maximum(np.abs(z[i]) - l1[i], 0)
        return -shrunk / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(passes):
        for index, value, label in examples:
            i, x = np.append(index, size), np.append(value, 1.0)
            w = weight(i)
            gradient = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            step = (np.sqrt(n[i] + gradient ** 2) - np.sqrt(n[i])) / ALPHA
            z[i] += gradient - step * w
            n[i] += gradient ** 2
    final = weight(np.arange(size + 1))
    return final[:size], float(final[size])


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, bits: int = BITS,
        sample_rows: int = SAMPLE_ROWS, passes: int = PASSES) -> Model:
    """Learn ``labels.quality`` from the texts of ``docs``. ``usable`` restricts the labels."""
    sample = labelled_sample(docs, labels, "quality", F.lit(True) if usable is None else usable, sample_rows)

    def vectors(batches):
        for batch in batches:
            data, offsets = text.column_bytes(batch.column(1))
            for a, b in text.pieces(data, offsets):
                part = offsets[a:b + 1] - offsets[a]
                row, index, value = sparse_vectors(data[offsets[a]:offsets[b]], part, bits)
                cut = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a),
                    pa.ListArray.from_arrays(cut, pa.array(index.astype(np.int32))),
                    pa.ListArray.from_arrays(cut, pa.array(value.astype(np.float32))),
                ], names=["__order", "__label", "index", "value"])

    def learn(batches):
        seen = []
        for batch in batches:
            for order, label, index, value in zip(*(batch.column(i) for i in range(4))):
                seen.append((order.as_py(), index.values.to_numpy(), value.values.to_numpy().astype(float), label.as_py()))
        if not seen:
            return
        seen.sort(key=lambda e: (e[0], len(e[1]), e[1].tobytes()))
        weights, bias = ftrl([e[1:] for e in seen], 1 << bits, passes)
        index = np.append(np.flatnonzero(weights), -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(index.astype(np.int64)), pa.array(np.append(weights[index[:-1]], bias))], names=["i", "w"])

    learned = (
        sample.mapInArrow(vectors, "__order long, __label int, index array<int>, value array<float>")
        .repartition(1).mapInArrow(learn, "i long, w double").toPandas()
    )
    weights, bias = np.zeros(1 << bits), 0.0
    for i, w in zip(learned["i"], learned["w"]):
        if i < 0:
            bias = float(w)
        else:
            weights[i] = w
    return Model(bits, bias, weights)


def scorer(spark, model: Model):
    """A column function from text to the chance that it is good."""
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(values: pa.Array) -> pa.Array:
        data, offsets = text.column_bytes(values)
        return pa.array(shared.value.scores(data, offsets))

    return score.asNondeterministic()


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` and a score column."""
    return docs.withColumn(name, scorer(docs.sparkSession, model)(F.col("text")))
