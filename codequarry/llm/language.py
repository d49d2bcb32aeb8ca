"""Language mixtures: expectation-maximisation over byte n-gram likelihoods.

Every language is a smoothed distribution over hashed byte trigrams of lower-cased text with
non-letters folded to one space. A document is a mixture of languages: EM finds the
proportions that make its trigrams likeliest. Which languages belong to the mixture is
decided by penalised likelihood: starting from the single best one, the language whose
gradient promises most is added as long as the gain exceeds the penalty for one more
proportion. The log-likelihood is concave in the proportions, so a language with a gradient
of at most one can not gain anything and the search stops exactly there.

Counts are taken over all usable documents in one pass: each task adds up its own counts and
hands on one row per language and block of cells, whatever it has read. The model has
``2**bits`` numbers per language.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Without any
usable document every text is ``und``. Ties go to the language that sorts first. Repeated
rows get equal results. Other columns are carried through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from . import text

BITS = 14
BLOCK = 32
UNKNOWN = "und"
#: Log-likelihood that one more language has to gain, times the log of the trigrams;
#: trigrams overlap, so one observation counts about three times.
PENALTY = 3.0
SMOOTHING = 0.5
STEPS = 30

_LETTER = regex.compile(r"\p{L}")
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def cells(document: str, bits: int = BITS) -> np.ndarray:
    """Hashed trigrams of a text, in order."""
    raw = _FOLD[np.frombuffer(f" {document.lower()} ".encode("utf-8", "replace"), np.uint8)]
    space = raw == 0x20
    raw = raw[~(space & np.append(False, space[:-1]))].astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    three = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    return ((three * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Chances of every cell by language; ``languages`` in order of their names."""

    languages: list[str]
    chances: np.ndarray  # cells x languages

    def mixture(self, document: str | None) -> tuple[str, float, np.ndarray]:
        """Main language, its share, and the share of every language."""
        none = np.zeros(len(self.languages))
        if not document or not self.languages or not _LETTER.search(document):
            return UNKNOWN, 0.0, none
        counts = np.bincount(cells(document), minlength=len(self.chances))
        seen = np.flatnonzero(counts)
        if not len(seen):
            return UNKNOWN, 0.0, none
        weight, chance = counts[seen].astype(float), self.chances[seen]
        n = weight.sum()
        alone = weight @ np.log(chance)
        chosen = [int(np.argmax(alone))]
        shares, best = np.ones(1), float(alone[chosen[0]])
        while len(chosen) < len(self.languages):
            slope = (weight / (chance[:, chosen] @ shares)) @ chance / n
            slope[chosen] = 0
            nxt = int(np.argmax(slope))
            cost = PENALTY * np.log(n + 1)
            if slope[nxt] <= 1 or n * (slope[nxt] - 1) <= cost:
                break
            trial, tried, value = chosen + [nxt], np.append(shares * 0.9, 0.1), -np.inf
            part = chance[:, trial]
            for _ in range(STEPS):
                mixed = part @ tried
                now = float(weight @ np.log(mixed))
                tried = tried * ((weight / mixed) @ part) / n
                if now - value < 1e-3:
                    break
                value = now
            if now - best <= cost:
                break
            chosen, shares, best = trial, tried, now
        out = none
        out[chosen] = shares / shares.sum()
        main = int(np.argmax(out))
        return self.languages[main], float(min(1.0, out[main])), out


def fit(docs: DataFrame, usable: Column | None = None, bits: int = BITS) -> Model:
    """Learn from ``text`` and ``lang`` of all rows where ``usable`` holds and lang is given."""
    size = 1 << bits

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, document in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = sums.setdefault(lang, np.zeros(size, np.int64))
                total += np.bincount(cells(document, bits), minlength=size)
        for lang, total in sums.items():
            blocks = size // BLOCK
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * blocks), pa.array(np.arange(blocks, dtype=np.int32)),
                 pa.ListArray.from_arrays((np.arange(blocks + 1) * BLOCK).astype(np.int32), pa.array(total))],
                names=["lang", "block", "counts"])

    rows = docs.where((F.lit(True) if usable is None else usable) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    partial = rows.select("lang", "text").mapInArrow(count, "lang string, block int, counts array<long>")
    # Sums with map-side combine: a task's rows shrink to one per language and block.
    found = partial.groupBy("lang", "block").agg(
        F.array(*(F.sum(F.col("counts")[i]) for i in range(BLOCK))).alias("counts")).toPandas()
    languages = sorted(set(found["lang"]))
    counts = np.zeros((size, len(languages)))
    for lang, block, part in zip(found["lang"], found["block"], found["counts"]):
        counts[block * BLOCK:(block + 1) * BLOCK, languages.index(lang)] = part
    counts += SMOOTHING
    return Model(languages, counts / counts.sum(axis=0) if languages else counts)


def with_language(docs: DataFrame, model: Model, name: str = "language") -> DataFrame:
    """``docs`` and a struct column: ``lang``, ``score`` and ``shares`` by language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang: string, score: double, shares: map<string, double>>")
    def predict(values: pa.Array) -> pa.Array:
        names = shared.value.languages
        found = [shared.value.mixture(v) for v in values.to_pylist()]
        shares = [[(n, float(s)) for n, s in zip(names, f[2]) if s > 0] for f in found]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
             pa.array(shares, pa.map_(pa.string(), pa.float64()))], names=["lang", "score", "shares"])

    return docs.withColumn(name, predict.asNondeterministic()(F.col("text")))
