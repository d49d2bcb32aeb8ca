"""Benchmark decontamination: pigeonhole edit matching.

A test item is in a document when some stretch of the document is within the item's error
budget, ``RATE`` of its length in edits. Both are compared without case, and with every run of
characters that are no letters or digits as one space. An item is split into one piece more
than its budget; with that many errors at most, one piece must stand unchanged. Exact piece
hits are found for all items in one pass over a text (Aho-Corasick), and the stretch around a
hit is verified with Myers' bit-parallel distance, free at both ends of the stretch. Chance
hits are ruled out before that: by the same principle some pair of pieces has one error at
most, and the budget also bounds how many three-character grams can be missing.

Items are a stated query set against all documents: they are taken in blocks of
``BLOCK_CHARS``, and each block is broadcast and answered in one scan. No pairs are made but
those found.

Defined results: a null or empty document matches nothing; an item without any letter or digit
is in no document. Of several stretches the one with the least distance is told, of those the
first. Repeated documents and items have rows of their own. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

RATE = 0.1
BLOCK_CHARS = 2_000_000

_WORDS = re.compile(r"[^\W_]+")


def folded(value: str) -> str:
    """What is compared: lower-case words with one space between them."""
    return " ".join(w.lower() for w in _WORDS.findall(value))


def places(value: str) -> list[tuple[int, int]]:
    """For each character of :func:`folded`, where it begins and ends in ``value``."""
    out: list[tuple[int, int]] = []
    for m in re.finditer(r"[^\W_]+", value):
        if out:
            out.append((out[-1][1], m.start()))
        for i in range(m.start(), m.end()):
            out += [(i, i + 1)] * len(value[i].lower())
    return out


def infix_distance(masks: dict[str, int], m: int, stretch: str, most: int) -> tuple[int, int]:
    """Least edit distance of a pattern of ``m`` characters (as ``masks`` of its characters) to a
    part of ``stretch``, and the end of the first such part; ``most + 1`` if above ``most``."""
    top, full = 1 << m - 1, (1 << m) - 1
    up, down, score = full, 0, m
    best, end = most + 1, 0
    get = masks.get
    for at, c in enumerate(stretch):
        eq = get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise = down | (full & ~(diagonal | up))
        fall = up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score < best:
                best, end = score, at + 1
        rise <<= 1  # no carry in: a match may begin anywhere
        fall <<= 1
        eq |= down
        up = full & (fall | ~(eq | rise))
        down = rise & eq & full
    return best, end


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def split(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of nearly equal length with their places; fewer if the item has
    fewer characters."""
    parts = min(budget + 1, len(item))
    cuts = [len(item) * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def _partner(parts: list[tuple[int, str]], i: int) -> tuple[int, int, str, str]:
    """The piece that makes a pair with piece ``i``: where it is from there, its size and halves.

    Pieces are paired from the left. If errors are fewer than pieces, they are fewer than
    pieces in some pair too: one of its pieces is exact and the other has one error at most, so
    one half of that is exact and at most one character away. The last of an odd number of
    pieces is of a group of three; neither it nor the two before it are asked for a partner."""
    if len(parts) % 2 and i >= len(parts) - 3:
        return 0, 0, "", ""
    at, piece = parts[i ^ 1]
    half = len(piece) // 2
    return at - parts[i][0], len(piece), piece[:half], piece[half:]


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = [(i, f, int(rate * len(f))) for i, f in ((i, folded(t)) for i, t in items) if f]
        self.masks: dict[int, tuple] = {}
        pieces: dict[str, list[tuple]] = {}
        for k, (_, item, budget) in enumerate(self.items):
            parts = split(item, budget)
            for i, (at, piece) in enumerate(parts):
                pieces.setdefault(piece, []).append((k, at, *_partner(parts, i)))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def _prepared(self, k: int):
        if k not in self.masks:
            item = self.items[k][1]
            self.masks[k] = (masks_of(item), masks_of(item[::-1]), [item[i:i + 3] for i in range(len(item) - 2)])
        return self.masks[k]

    def find(self, document: str) -> list[dict]:
        """The items that are in a document, with distance and place."""
        if self.empty:
            return []
        body = folded(document)
        asked: dict[int, list[int]] = {}
        for end, (length, uses) in self.automaton.iter(body):
            start = end + 1 - length
            for k, at, shift, size, front, back in uses:
                if size:
                    near = body[max(0, start + shift - 1):start + shift + size + 1]
                    if front not in near and back not in near:
                        continue
                asked.setdefault(k, []).append(start - at)
        found = []
        where = None
        for k, starts in asked.items():
            name, item, budget = self.items[k]
            masks, back, grams = self._prepared(k)
            best, place = budget + 1, (0, 0)
            for low, high in self._stretches(sorted(set(starts)), len(item), budget, len(body)):
                stretch = body[low:high]
                if budget:
                    held = {stretch[i:i + 3] for i in range(len(stretch) - 2)}
                    if sum(g in held for g in grams) < len(grams) - 3 * budget:
                        continue
                distance, end = infix_distance(masks, len(item), stretch, budget)
                if distance < best:
                    _, length = infix_distance(back, len(item), stretch[max(0, end - len(item) - budget):end][::-1], distance)
                    best, place = distance, (low + end - length, low + end)
                    if distance == 0:
                        break
            if best <= budget:
                where = where or places(document)
                found.append({"item_id": name, "distance": best, "start": where[place[0]][0], "end": where[place[1] - 1][1]})
        return found

    @staticmethod
    def _stretches(starts: list[int], length: int, budget: int, size: int) -> Iterator[tuple[int, int]]:
        """Parts of the text that a match through the hits may cover, overlapping ones as one
        while they are not much longer than a single one."""
        low = high = None
        for s in starts:
            a, b = max(0, s - budget), min(size, s + length + budget)
            if low is None:
                low, high = a, b
            elif a - low <= length:
                high = max(high, b)
            else:
                yield low, high
                low, high = a, b
        if low is not None:
            yield low, high


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """The items in blocks of at most ``most`` characters, or one item."""
    block, size = [], 0
    for row in items.where("text is not null").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if block and size + len(row["text"]) > most:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, column: str = "matches") -> DataFrame:
    """``docs`` and an array column of ``item_id, distance, start, end`` of the items in each
    text; places count code points of the text as it is."""
    spark = docs.sparkSession
    hit = T.StructType([
        T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("distance", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    out = F.array().cast(T.ArrayType(hit))
    for block in _blocks(items, BLOCK_CHARS):
        out = F.concat(out, _finder(spark.sparkContext.broadcast(block), rate, hit)(F.col("text")))
    return docs.withColumn(column, out)


def _finder(shared, rate: float, hit: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(T.ArrayType(hit))
    held: list[Matcher] = []

    @arrow_udf(T.ArrayType(hit))
    def find(values: pa.Array) -> pa.Array:
        if not held:
            held.append(Matcher(shared.value, rate))
        return pa.array([held[0].find(v) if v else [] for v in values.to_pylist()], kind)

    return find.asNondeterministic()
