"""Toxicity: boosted trees over dense text features, calibrated by isotonic regression.

Features of a text, all shares or distances, so that they do not follow its length:

* lexicon densities: words and word beginnings that labelled toxic documents use and others
  do not (learned), the same after undoing look-alike spelling ("1d10t"), and a short fixed
  list of insults;
* second-person proximity: share of words that address the reader, share of lexicon words
  with such a word near by, nearest distance;
* shares of capitals, capital words, exclamation and question marks, other punctuation,
  symbols inside words, digits inside words, single letters in a row, repeated letters.

Lexicon, trees and calibration are learned from a bounded sample of labels (``SAMPLE_ROWS`` of
either label), cross-fitted over three hashed parts: a text's features use the lexicon of the
other parts, and the calibration sees margins of trees from the other parts, so a word that
merely occurs in one toxic document does not count for it. Where the bound cuts a label, its
rows weigh as many labels as they stand for, so that scores are chances in the whole table
however large it is. The sample meets in one task; the result, lexicon (``LEXICON_SIZE`` hashes
at most) and trees, is of fixed size.

Defined results: a null or empty text has zero features and gets their score. Without usable
labels every text scores 0.5. Repeated rows get equal scores. Other columns are carried
through.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from . import text, trees
from .training import labelled_sample

SAMPLE_ROWS = 4000
LEXICON_SIZE = 4000
#: Documents a lexicon entry must be in, and the log-odds it must have.
LEXICON_DOCS, LEXICON_ODDS = 4, 2.0
#: Lengths in bytes of word beginnings.
STEMS = (4, 5)
NEAR = 5
THRESHOLD = 0.5

# Words that address the reader, and insults, in the languages served.
SECOND_PERSON = (
    "you your yours yourself ya u du dich dir dein deine deinen ihr euch euer sie ihnen tu toi te ton ta tes "
    "vous votre vos usted ustedes ti tu tus vosotros vuestro"
).split()
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers trash scum pathetic worthless disgusting clown fool "
    "jerk ugly garbage filth dummkopf blödmann arschloch trottel abschaum dumm imbécile crétin connard salaud "
    "débile ordure stupide imbécil estúpido tonto basura asqueroso cabrón"
).split()
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "u"}

_WORD = np.zeros(256, np.uint8)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1),
       *range(0x80, 0x100)]] = 1
_JOINED = _WORD.copy()
_JOINED[[ord(c) for c in "@$*"]] = 1
_PLAIN = text.LOWER.copy()
for _from, _to in LOOKALIKES.items():
    _PLAIN[ord(_from)] = ord(_to)


def _class(chars) -> np.ndarray:
    out = np.zeros(256, np.float32)
    out[[ord(c) for c in chars]] = 1
    return out


_CAPITAL = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class("0123456789")
_LETTER = _WORD.astype(np.float32) - _DIGIT
_CLASSES = (_CAPITAL, _DIGIT, _class("!"), _class("?"), _class(".,;:"), _class("#$%&*@^~|\\/<>=+_"))
FEATURES = 21


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data = text.LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    ends = np.cumsum([len(r) for r in raw])
    return np.unique(text.SpanHash(data)(np.append(0, ends[:-1]), ends))


class Words:
    """Hashes of the words of a piece: as they are, their beginnings, and with look-alikes undone."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        lower = text.LOWER[data]
        self.start, self.end = text.token_bounds(_WORD[data], offsets)
        spans = text.SpanHash(lower)
        self.word = spans(self.start, self.end)
        self.stems = [spans(self.start, np.minimum(self.end, self.start + k)) ^ np.uint64(k) for k in STEMS]
        first = text.per_text(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        begin, end = text.token_bounds(_JOINED[data], offsets)
        letter = np.concatenate([[0], np.cumsum(_LETTER[data])])
        odd = np.flatnonzero((letter[end] - letter[begin] > 0) & (letter[end] - letter[begin] < end - begin))
        self.odd_row = np.searchsorted(offsets, begin[odd], side="right") - 1
        self.plain = text.SpanHash(_PLAIN[data])(begin[odd], end[odd]) if len(odd) else np.zeros(0, np.uint64)


def _held(sorted_hashes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(sorted_hashes):
        return np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(sorted_hashes, asked), len(sorted_hashes) - 1)
    return sorted_hashes[at] == asked


def features(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray, insults: np.ndarray,
             you: np.ndarray) -> np.ndarray:
    """``FEATURES`` numbers for every text of a piece."""
    n = len(offsets) - 1
    out = np.zeros((n, FEATURES))
    if not len(data):
        return out
    w = Words(data, offsets)
    size = np.maximum(np.diff(offsets), 1).astype(float)
    words = np.maximum(np.bincount(w.row, minlength=n), 1).astype(float)

    def share(mask, row=w.row):
        return np.bincount(row, mask, n) / words

    known = _held(lexicon, w.word)
    stems = [_held(lexicon, s) for s in w.stems]
    marked = known | stems[0] | stems[1]
    mean = _held(insults, w.word)
    plain = _held(lexicon, w.plain) | _held(insults, w.plain)
    address = _held(you, w.word)
    out[:, 0], out[:, 1], out[:, 2] = share(known), share(stems[0]), share(stems[1])
    out[:, 3], out[:, 4] = share(marked), np.bincount(w.row, marked, n)
    out[:, 5], out[:, 6] = share(mean), share(plain, w.odd_row)
    out[:, 7] = share(address)
    place = np.arange(len(w.row))
    here = np.flatnonzero(address)
    gap = np.full(len(w.row), np.inf)
    if len(here):
        after = np.searchsorted(here, place)
        for side in (np.minimum(after, len(here) - 1), np.maximum(after - 1, 0)):
            other = here[side]
            gap = np.minimum(gap, np.where(w.row[other] == w.row, np.abs(other - place), np.inf))
    bad = marked | mean
    out[:, 8] = share(bad & (gap <= NEAR))
    nearest = np.full(n, 1e3)
    np.minimum.at(nearest, w.row[bad], np.minimum(gap[bad], 1e3))
    out[:, 9] = 1 / (1 + nearest)
    empty = np.diff(offsets) == 0
    for k, kind in enumerate(_CLASSES):
        sums = np.concatenate([[0], np.cumsum(kind[data], dtype=np.float64)])
        out[:, 10 + k] = (sums[offsets[1:]] - sums[offsets[:-1]]) / size
    capital = np.concatenate([[0], np.cumsum(_CAPITAL[data], dtype=np.float64)])
    length = w.end - w.start
    out[:, 16] = share((capital[w.end] - capital[w.start] == length) & (length > 1))
    out[:, 17] = np.bincount(w.odd_row, minlength=n) / words
    single = length == 1
    out[:, 18] = share(single & np.append(single[1:] & (w.row[1:] == w.row[:-1]), False)) if len(single) else 0
    triple = np.zeros(len(data))
    if len(data) > 2:
        triple[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (_LETTER[data[2:]] > 0)
        # The first two bytes of a text have no two before them in it.
        for k in (0, 1):
            triple[np.minimum(offsets[:-1] + k, len(data) - 1)[offsets[:-1] + k < len(data)]] = 0
    repeated = np.concatenate([[0], np.cumsum(triple)])
    out[:, 19] = (repeated[offsets[1:]] - repeated[offsets[:-1]]) / size
    out[:, 20] = np.log1p(words)
    out[empty] = 0
    return out


def learn_lexicon(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Hashes of words and word beginnings that toxic documents have and others have not."""
    toxic, clean = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    hashes: list[list] = [[] for _ in range(1 + len(STEMS))]
    owners: list[list] = [[] for _ in range(1 + len(STEMS))]
    for a, b in text.pieces(data, offsets):
        w = Words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
        for k, found in enumerate((w.word, *w.stems)):
            order = np.lexsort((found, w.row))
            h, r = found[order], w.row[order]
            once = np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))[:len(h)]
            hashes[k].append(h[once])
            owners[k].append(labels[a + r[once]])
    entries = []
    for found, toxicity in zip(hashes, owners):
        if not found:
            continue
        values, which = np.unique(np.concatenate(found), return_inverse=True)
        bad = np.bincount(which, np.concatenate(toxicity), len(values))
        good = np.bincount(which, minlength=len(values)) - bad
        odds = np.log((bad + 0.5) / toxic) - np.log((good + 0.5) / clean)
        telling = np.flatnonzero((bad >= LEXICON_DOCS) & (odds >= LEXICON_ODDS))
        entries += [(-odds[i] * np.sqrt(bad[i]), values[i]) for i in telling]
    entries.sort()
    return np.unique(np.array([v for _, v in entries[:LEXICON_SIZE]], np.uint64))


@dataclass(frozen=True)
class Model:
    lexicon: np.ndarray
    insults: np.ndarray
    you: np.ndarray
    forest: trees.Forest | None
    calibration: trees.Isotonic | None

    def dense(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        parts = [features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], self.lexicon, self.insults, self.you)
                 for a, b in text.pieces(data, offsets)]
        return np.concatenate(parts) if parts else np.zeros((0, FEATURES))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.forest is None:
            return np.full(len(offsets) - 1, 0.5)
        return np.clip(self.calibration(self.forest.margin(self.dense(data, offsets))), 0, 1)


def learn(data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, part: np.ndarray, weight: np.ndarray) -> Model:
    """A model from labelled texts, cross-fitted over their parts 0, 1 and 2. Of the weights
    only the proportions count: what ridge and pseudo-counts are held against is the sample."""
    insults, you = _hashes(INSULTS), _hashes(SECOND_PERSON)

    def of(rows):
        pieces = [data[offsets[r]:offsets[r + 1]] for r in rows]
        ends = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        return np.concatenate([*pieces, np.zeros(0, np.uint8)]), ends

    def lexicon_of(rows):
        d, o = of(rows)
        return learn_lexicon(d, o, labels[rows].astype(float))

    y = labels.astype(float)
    weight = weight / weight.mean()
    dense = np.zeros((len(y), FEATURES))
    parts = [np.flatnonzero(part == k) for k in range(3)]
    for own in parts:
        others = np.setdiff1d(np.arange(len(y)), own)
        if len(own):
            dense[own] = Model(lexicon_of(others), insults, you, None, None).dense(*of(own))
    margin = np.zeros(len(y))
    for own in parts:
        others = np.setdiff1d(np.arange(len(y)), own)
        margin[own] = trees.fit(dense[others], y[others], weight=weight[others]).margin(dense[own])
    return Model(lexicon_of(np.arange(len(y))), insults, you, trees.fit(dense, y, weight=weight), trees.isotonic(margin, y, weight))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn ``labels.toxic`` from the texts of ``docs``. ``usable`` restricts the labels."""
    sample = labelled_sample(docs, labels, "toxic", F.lit(True) if usable is None else usable, sample_rows, per_class=True)

    def train(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        if not rows:
            return
        rows.sort()
        data, offsets = text.column_bytes(pa.array([r[1] for r in rows], pa.string()))
        model = learn(data, offsets, np.array([r[2] for r in rows]), np.array([r[0] % 3 for r in rows]),
                      np.array([r[3] for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(
            (model.lexicon, model.forest.__dict__, model.calibration.__dict__))], pa.binary())], names=["model"])

    made = sample.repartition(1).mapInArrow(train, "model binary").collect()
    insults, you = _hashes(INSULTS), _hashes(SECOND_PERSON)
    if not made:
        return Model(np.zeros(0, np.uint64), insults, you, None, None)
    lexicon, forest, calibration = pickle.loads(made[0][0])
    return Model(lexicon, insults, you, trees.Forest(**forest), trees.Isotonic(**calibration))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` and the calibrated chance that a text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(values: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(*text.column_bytes(values)))

    return docs.withColumn(name, score.asNondeterministic()(F.col("text")))
