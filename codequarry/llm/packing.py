"""Sequence packing as a cutting-stock problem, solved by column generation.

Documents become token ids, each with an end id. Longer ones are cut into full sequences and a
rest; rests are counted by length class (``GRAIN`` tokens, rounded up), which leaves a
histogram of at most ``length / GRAIN`` numbers whatever the corpus. On it a linear program over
patterns (how many pieces of each class share a sequence) is solved by revised simplex: the
dual prices go into a knapsack dynamic program, whose best filling is the next pattern, until
none pays. Short pieces, of which rounding up would waste much, are first laid together in
bundles that count as one piece. Pattern counts are rounded down and what is left, a few pieces a class, is packed
first-fit decreasing.

Pieces of a class are ranked, and each pattern takes a range of ranks of its classes, so a
piece finds its sequence by a search in a small table. Ranks come from two levels: a hash deals
the pieces of a class into parts of bounded size, parts are counted and their counts summed
up, and only inside a part are rows numbered. No class is ever ordered as a whole, though one
may hold most pieces.

Texts are tokenised word by word: the tokenizer splits at white space and between letters and
punctuation anyway, so equal words are tokenised once and looked up then. The tokenizer file is
read on the driver and broadcast; it does not grow with the data.

Defined results: a null or empty text is a document of the end id alone. Equal lengths are
ranked by hash, id and start. Repeated rows are documents of their own. An empty table gives
no rows. Other columns are not looked at.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from . import text
from ..plans.checkpoints import cut, cut_counted

LENGTH = 4096
GRAIN = 16
#: Pieces of up to SHORT tokens are laid together in bundles, of 5 * SHORT tokens at most.
SHORT = 160
END_ID = 2
PART_ROWS = 20_000
PIECE_BYTES = 512 << 10
MOST_WORDS, AT_ONCE = 600_000, 4096
MOST_PATTERNS = 20_000


# --- tokens -----------------------------------------------------------------------------

class WordTokens:
    """Ids of words by hash, each word tokenised once (the table starts anew when it is full)."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.forget()

    def forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int32)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        found = []
        for k in range(0, len(words), AT_ONCE):  # the tokenizer's own results are large
            found += [e.ids for e in self.tokenizer.encode_batch_fast(words[k:k + AT_ONCE], add_special_tokens=False)]
        count = np.array([len(f) for f in found], np.int64)
        ids = np.fromiter((i for f in found for i in f), np.uint32, int(count.sum()))
        at = np.searchsorted(self.hash, hashes)  # both are in order
        self.start = np.insert(self.start, at, len(self.ids) + np.cumsum(count) - count)
        self.count = np.insert(self.count, at, count)
        self.hash = np.insert(self.hash, at, hashes)
        self.ids = np.concatenate([self.ids, ids])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a piece, joined, and where each text starts."""
        # A special token is found in the text as it stands, so its letters keep their case.
        plain = data if (data == ord("<")).any() else text.LOWER[data]
        starts, ends = _words(plain, offsets)
        word = text.SpanHash(plain)(starts, ends)
        kinds, first, which = np.unique(word, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, kinds)
        known = np.zeros(len(kinds), bool)
        if len(self.hash):
            known = self.hash[np.minimum(at, len(self.hash) - 1)] == kinds
        if not known.all():
            if len(self.hash) > MOST_WORDS:
                self.forget()
                known[:] = False
            new = np.flatnonzero(~known)
            raw = plain.tobytes()
            self.learn(kinds[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first[new]], ends[first[new]])])
            at = np.searchsorted(self.hash, kinds)
        count = self.count[at][which].astype(np.int64)
        begin = self.start[at][which].astype(np.int64)
        shift = np.cumsum(count) - count
        ids = self.ids[np.repeat(begin - shift, count) + np.arange(int(count.sum()))]
        place = np.append(shift, len(ids))
        return ids, place[text.per_text(starts, offsets)]


_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of what lies between white space, cut between an ASCII letter and a mark too:
    the tokenizer never joins anything across those places."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~text.SPACE[data]
    letter, mark = _LETTER[data], _MARK[data]
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    change[1:n] = (solid[1:] != solid[:-1]) | (letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])
    change[offsets] = True
    edges = np.flatnonzero(change)
    keep = solid[edges[:-1]]
    return edges[:-1][keep], edges[1:][keep]


def _word_tokens(source: str) -> WordTokens:
    """The word table of this process, shared by its tasks."""
    # Spark's tasks share the cores already; threads of the tokenizer would only hold memory.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    place = sys.modules.setdefault("codequarry_word_tokens", types.ModuleType("codequarry_word_tokens"))
    held = getattr(place, "held", None)
    if held is None or held[0] != (key := zlib.crc32(source.encode())):
        held = place.held = (zlib.crc32(source.encode()), WordTokens(Tokenizer.from_str(source)))
    return held[1]


def pieces_of(docs: DataFrame, source: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """``doc_id, doc_tokens, start, length, ids_crc32`` for every piece of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(source)
    piece = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    @arrow_udf(T.StructType([
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("pieces", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])))]))
    def tokenise(values: pa.Array) -> pa.Array:
        tokens = _word_tokens(shared.value)
        data, offsets = text.column_bytes(values)
        totals, cuts, starts, lengths, sums = [], [0], [], [], []
        for a, b in text.pieces(data, offsets, PIECE_BYTES):
            ids, place = tokens(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            for k in range(b - a):
                own = np.append(ids[place[k]:place[k + 1]], np.uint32(end_id)).astype("<u4")
                totals.append(len(own))
                for s in range(0, len(own), length):
                    part = own[s:s + length]
                    starts.append(s)
                    lengths.append(len(part))
                    sums.append(zlib.crc32(part.tobytes()))
                cuts.append(len(starts))
        flat = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], fields=list(piece))
        return pa.StructArray.from_arrays(
            [pa.array(totals, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat)], names=["doc_tokens", "pieces"])

    return (
        docs.select("doc_id", tokenise.asNondeterministic()(F.col("text")).alias("t"))
        .select("doc_id", "t.doc_tokens", F.explode("t.pieces").alias("p")).select("doc_id", "doc_tokens", "p.*")
    )


# --- patterns ---------------------------------------------------------------------------

def best_filling(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the best value and how many of each kind it takes."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fits = int(np.searchsorted(size, c, side="right"))  # sizes ascend
        if fits:
            got = best[c - size[:fits]] + value[:fits]
            k = int(np.argmax(got))
            if got[k] > best[c] + 1e-12:
                best[c], choice[c] = got[k], k
    taken = np.zeros(len(size), np.int64)
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            taken[choice[c]] += 1
            c -= size[choice[c]]
    return float(best[capacity]), taken


def column_generation(size: np.ndarray, demand: np.ndarray, capacity: int, most: int = MOST_PATTERNS):
    """Patterns (columns) and how often the linear program uses each: least sequences that
    hold the demand. ``most`` pivots at most; any basis on the way is a valid solution."""
    m = len(size)
    basis = np.diag((capacity // size).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    amount = inverse @ demand
    for pivot in range(most):
        if pivot and pivot % 200 == 0:  # fresh inverse against rounding errors
            inverse = np.linalg.inv(basis)
            amount = inverse @ demand
        value, column = best_filling(np.maximum(inverse.sum(axis=0), 0), size, capacity)
        if value <= 1 + 1e-7:
            break
        turn = inverse @ column
        able = turn > 1e-9
        if not able.any():
            break
        ratio = np.where(able, np.maximum(amount, 0) / np.where(able, turn, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = column
        row = inverse[out] / turn[out]
        inverse -= np.outer(turn, row)
        inverse[out] = row
        step = ratio[out]
        amount = amount - step * turn
        amount[out] = step
    return np.rint(basis).astype(np.int64), np.maximum(amount, 0)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """``(pieces by class, how many sequences)`` that hold the histogram exactly."""
    size = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in size], np.int64)
    if not len(size):
        return []
    basis, amount = column_generation(size, demand.astype(float), capacity)
    times = np.floor(amount + 1e-6).astype(np.int64)
    # Rounding errors must not take more pieces than there are.
    for k in np.argsort(-times):
        over = demand - basis @ times
        if (over >= 0).all():
            break
        short = over < 0
        need = np.max(np.where(basis[short, k] > 0, -(over[short] // np.maximum(basis[short, k], 1)), 0), initial=0)
        times[k] = max(0, times[k] - need)
    made = [({int(s): int(c) for s, c in zip(size, basis[:, k]) if c}, int(times[k])) for k in range(len(size)) if times[k] > 0]
    left = demand - basis @ times
    bins: list[list] = []
    for s, count in zip(size[::-1], left[::-1]):
        for _ in range(int(count)):
            for b in bins:
                if b[0] >= s:
                    break
            else:
                bins.append(b := [capacity, {}])
            b[0] -= s
            b[1][int(s)] = b[1].get(int(s), 0) + 1
    return made + [(b[1], 1) for b in bins]


@dataclass(frozen=True)
class Seats:
    """For each class: from which rank on pieces go to which pattern."""

    table: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def __call__(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and seat in it of every piece."""
        sequence, seat = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size):
            rows = np.flatnonzero(size == s)
            first, each, base, shift = self.table[int(s)]
            k = np.searchsorted(first, rank[rows], side="right") - 1
            inner = rank[rows] - first[k]
            sequence[rows] = base[k] + inner // each[k]
            seat[rows] = shift[k] + inner % each[k]
        return sequence, seat


def seats(patterns: list[tuple[dict[int, int], int]]) -> Seats:
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    base = 0
    for pattern, times in patterns:
        shift = 0
        for s, each in sorted(pattern.items(), reverse=True):
            rows.setdefault(s, []).append((used.get(s, 0), each, base, shift))
            used[s] = used.get(s, 0) + each * times
            shift += each
        base += times
    return Seats({s: tuple(np.array(c, np.int64) for c in zip(*r)) for s, r in rows.items()})


def _bundled(pieces: DataFrame, parts: int, short: int, length: int) -> DataFrame:
    """``pieces`` with the item each belongs to: ``part``, ``bundle`` and the place ``inside`` it.

    Rounding up to the grain would cost short pieces more than they are long. They are dealt
    into parts of bounded size by hash and laid end to end there; what begins in the same stretch
    is one item. Stretches are a few times as long as the longest short piece of the part, so
    that items are large against the grain and small against a sequence. A longer piece is
    an item of its own (``bundle`` null)."""
    brief = F.col("length") <= short
    order = ["doc_id", "start", "length", "ids_crc32"]
    whole = Window.partitionBy("part")
    earlier = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        pieces.where(brief).withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "length"), F.lit(parts)))
        .withColumn("before", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
        .withColumn("longest", F.max("length").over(whole))
        .withColumn("bundle", F.floor(F.col("before") / (F.greatest(F.lit(length // 16), 5 * F.col("longest")) + 1 - F.col("longest"))))
        .drop("longest")
    )
    first = F.min("before").over(Window.partitionBy("part", "bundle"))
    laid = laid.withColumn("inside", F.col("before") - first).drop("before")
    none = F.lit(None).cast("long")
    return laid.unionByName(pieces.where(~brief).withColumns({"part": none, "bundle": none, "inside": F.lit(0).cast("long")}))


def pack(docs: DataFrame, source: str, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens: ``doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset``. ``source`` is the text of a tokenizer file."""
    spark = docs.sparkSession
    short = min(SHORT, length // 16)
    pieces, brief = cut_counted(pieces_of(docs, source, length), F.col("length") <= short)
    held = cut(_bundled(pieces, max(1, brief // PART_ROWS), short, length))
    # Items: long pieces, with their rows, and bundles, whose rows follow them to their seats.
    single = F.col("bundle").isNull()
    bundles = held.where(~single).groupBy("part", "bundle").agg(F.sum("length").alias("length"))
    items = held.where(single).drop("inside").unionByName(bundles, allowMissingColumns=True)
    items = cut(items.withColumn("size", F.ceil(F.col("length") / grain).cast("long")))
    histogram = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}
    table = spark.sparkContext.broadcast(seats(plan(histogram, length // grain)))
    parts = max(1, sum(histogram.values()) // PART_ROWS)
    key = ["doc_id", "start", "ids_crc32", "part", "bundle"]
    dealt = items.withColumn("lot", F.pmod(F.xxhash64(*key), F.lit(parts)))
    counts = dealt.groupBy("size", "lot").count()
    before = counts.select(
        "size", "lot", (F.sum("count").over(Window.partitionBy("size").orderBy("lot")) - F.col("count")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("size", "lot").orderBy(*key, "length"))
    ranked = dealt.withColumn("inner", inner).join(before, ["size", "lot"]).withColumn("rank", F.col("before") + F.col("inner") - 1)

    @arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("seat", T.LongType())]))
    def seated(size: pa.Array, rank: pa.Array) -> pa.Array:
        found = table.value(size.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(f) for f in found], names=["sequence_id", "seat"])

    placed = ranked.withColumn("s", seated("size", "rank")).select(*key, "doc_tokens", "length", "s.sequence_id", "s.seat")
    # A sequence has at most length / grain items.
    earlier = Window.partitionBy("sequence_id").orderBy("seat").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("seat")
    if not brief:
        return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    placed = cut(placed)
    followed = held.where(~single).join(
        placed.where(~single).select("part", "bundle", "sequence_id", F.col("offset").alias("begin")), ["part", "bundle"],
    ).withColumn("offset", F.col("begin") + F.col("inside"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.where(single).select(columns).unionByName(followed.select(columns))


def tokenizer_source(path: str | None = None) -> str:
    """The text of a tokenizer file; by default of the public word tokenizer of this machine."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()
