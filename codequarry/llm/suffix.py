"""Exact substring deduplication with a logarithmic family of sampled suffix arrays.

A byte is removed when a string of ``window`` bytes that covers it also starts in a document
with a smaller id. Suffixes are sampled: in every window the ``GRAM``-byte gram with the
smallest hash is the anchor, equal windows have equal anchors, and the windows of one anchor
form a run. A run with its text is an entry of the index, ordered by its anchor; all windows
that can be equal meet under one anchor, so the sample loses nothing.

1. Documents are dealt into groups of about ``GROUP_BYTES`` of text. A group tells the hash
   ranges ("buckets") two short hashes for every anchor, of the bytes that its windows share on
   either side, and hears back which of them other documents have too. All else is unique.
2. Runs that are left go, packed with their text, to the buckets of their anchors, in batches
   of ascending document id; equal runs of a group go once and the copies of its later
   documents are removed on the spot. A bucket holds an index family. Each batch is ordered
   into a suffix array of its own and merge-scanned against the levels that are there, for the
   smallest id with the same window. What is new becomes a level, and levels merge while the
   last is not much smaller than the one before. Buckets are as many as ``BUCKET_BYTES`` of
   text go into the corpus, so a family fits a task at any size.
3. Removed ranges go back, packed, to the groups of their documents. The groups themselves are
   shuffled once; all three steps read the same exchange.

A passage that stands in a large share of all documents would bring its anchors' runs to one
bucket, with as many different surroundings as documents. Such anchors are found on a hashed
share of the documents (which changes where entries go, never the result); their runs are
cut at fixed distances from the anchor and dealt by the bytes that all their windows share.

Defined results: a null text is empty. Texts below ``window`` bytes are kept whole. Rows of
one id are one document: they never remove each other's bytes. A row without id keeps its
bytes and removes none, so such rows, however many, are in no group and are never shuffled.
Repeated rows get equal results. Other columns are carried through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import text
from ..plans.checkpoints import cut

GRAM = 12
BUCKET_BYTES = 4 << 20
GROUP_BYTES = 6 << 20
BATCHES = 8
#: An anchor is common when it stands in more than this share of the documents looked at;
#: at most 1 / COMMON times the runs of a document can be.
COMMON, COMMON_SHARE = 1 / 500, 64
SUB_RUN = 4

_A = np.uint64(0x9E6C63D0876A9A99)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_U = np.uint64


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number (zeros after the end)."""
    padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
    padded[:len(data)] = data
    out = np.empty(len(padded) - 8, _U)
    for k in range(8):
        out[k::8] = padded[k:k + len(out)].view("<u8")
    return out[:len(data)]


def grams(eight: np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM`` bytes from each position."""
    return text.mixed(eight[:len(eight) - GRAM + 8] * _A ^ np.roll(eight, 8 - GRAM)[:len(eight) - GRAM + 8] * _B)


def string_hashes(eight: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``length`` bytes from the positions ``at``."""
    h = np.full(len(at), length, _U)
    for k in [*range(0, length - 8, 8), length - 8]:
        h = (h ^ eight[at + k]) * _A
        h ^= h >> _U(29)
    return text.mixed(h)


@dataclass
class Runs:
    """Windows with a common anchor: where they start, how many, and where the anchor is."""

    start: np.ndarray
    count: np.ndarray
    anchor_at: np.ndarray
    anchor: np.ndarray

    def take(self, which: np.ndarray) -> "Runs":
        return Runs(self.start[which], self.count[which], self.anchor_at[which], self.anchor[which])


def find_runs(eight: np.ndarray, offsets: np.ndarray, window: int) -> Runs:
    """All windows of the texts of a piece, as runs by anchor."""
    n = len(eight)
    none = np.zeros(0, np.int64)
    if n < window:
        return Runs(none, none, none, np.zeros(0, _U))
    h = grams(eight)
    low = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=_U)
    span, wide = 1, window - GRAM + 1
    while span * 2 <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if wide > span:
        low = np.minimum(low[:-(wide - span)], low[wide - span:])
    inside = np.zeros(n + 1, np.int32)
    long = np.diff(offsets) >= window
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(inside)[:len(low)] > 0)
    if not len(at):
        return Runs(none, none, none, np.zeros(0, _U))
    low = low[at]
    fresh = np.empty(len(at), bool)
    fresh[0] = True
    fresh[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(fresh)
    anchor_at = (low[heads] & _U(0xFFFFFFFF)).astype(np.int64)
    return Runs(at[heads], np.diff(np.append(heads, len(at))), anchor_at, h[anchor_at])


def split_runs(runs: Runs, which: np.ndarray) -> Runs:
    """The runs ``which``, cut where the distance to the anchor is a multiple of SUB_RUN."""
    r = runs.take(which)
    owner = np.repeat(np.arange(len(r.start)), r.count)
    start = r.start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(r.count) - r.count, r.count)
    part = (r.anchor_at[owner] - start) // SUB_RUN
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
    heads = np.flatnonzero(fresh)
    own = owner[heads]
    return Runs(start[heads], np.diff(np.append(heads, len(owner))), r.anchor_at[own], r.anchor[own])


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The spans of ``data`` one after the other."""
    shift = start - (np.cumsum(length) - length)
    return data[np.repeat(shift, length) + np.arange(int(length.sum()))]


# --- packing ---------------------------------------------------------------------------

_PARTS = (("doc", np.int64), ("key", np.int64), ("group", np.int32), ("start", np.int32),
          ("count", np.uint16), ("whole", np.bool_))


def pack(fields: dict[str, np.ndarray], body: bytes) -> bytes:
    n = len(fields["doc"])
    raw = b"".join([np.int64(n).tobytes(), *(fields[k].astype(t).tobytes() for k, t in _PARTS), body])
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(blob: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, place, fields = int(np.frombuffer(raw, np.int64, 1)[0]), 8, {}
    for k, t in _PARTS:
        fields[k] = np.frombuffer(raw, t, n, place)
        place += n * np.dtype(t).itemsize
    return fields, np.frombuffer(raw, np.uint8, offset=place)


# --- 1: which anchors other documents have -------------------------------------------------

def sides(runs: Runs, eight: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many windows of each run start far before their anchor (``left``), the hash of the
    bytes that those share, and of the bytes that the others share."""
    far = (window - GRAM + 1) // 2
    left = np.clip(runs.anchor_at - runs.start - far + 1, 0, runs.count)
    before = string_hashes(eight, np.maximum(runs.anchor_at - far, 0), far + GRAM)
    after = string_hashes(eight, np.minimum(runs.anchor_at, len(eight) - 1), window - far + 1)
    return left, before, after ^ _B


def _cells(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of a hash in one number."""
    return ((hashes >> _U(34)) % _U(buckets)) << _U(32) | (hashes & _U(0xFFFFFFFF))


def _usable(rows: pa.Table) -> pa.Table:
    """Rows with text. They are taken here and not before the exchange, so that all steps ask
    for the same exchange."""
    return rows.filter(rows.column("text").is_valid())


def _group_pieces(rows: pa.Table, window: int):
    """Of the texts of a group, piece by piece: bytes, offsets, row range, numbers, runs, sides."""
    data, offsets = text.column_bytes(rows.column("text"))
    for a, b in text.pieces(data, offsets):
        part = offsets[a:b + 1] - offsets[a]
        body = data[offsets[a]:offsets[b]]
        # Eight zero bytes, so that hashes near the end of the piece have something to read.
        eight = eights(np.append(body, np.zeros(window, np.uint8)))
        runs = find_runs(eight[:len(body)], part, window)
        if len(runs.start):
            yield body, part, a, b, eight, runs, sides(runs, eight, window)


def _announce(window: int, buckets: int):
    """A group to its side hashes by bucket."""
    def run(rows: pa.Table) -> pa.Table:
        group = rows.column("__group")[0].as_py()
        rows = _usable(rows)
        doc = rows.column("doc_id").to_numpy()
        seen = []
        for _, part, a, b, _, runs, (left, before, after) in _group_pieces(rows, window):
            own = doc[a:b][np.searchsorted(part, runs.start, side="right") - 1]
            for some, hashes in ((left > 0, before), (left < runs.count, after)):
                seen.append(np.unique(np.stack([_cells(hashes[some], buckets), own[some].view(_U)], 1), axis=0))
        cells = np.concatenate(seen)[:, 0] if seen else np.zeros(0, _U)
        if len(seen) > 1:
            cells = np.unique(np.concatenate(seen), axis=0)[:, 0]
        cells, docs = np.unique(cells, return_counts=True)
        bucket = (cells >> _U(32)).astype(np.int32)
        heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(cells) else np.zeros(0, int)
        ends = np.append(heads[1:], len(cells))
        blobs = [_squeeze(cells[x:y], docs[x:y] > 1) for x, y in zip(heads, ends)]
        return pa.table([pa.array(bucket[heads]), pa.array([group] * len(heads), pa.int32()), pa.array(blobs, pa.binary())], schema=_TOLD)

    return run


def _squeeze(cells: np.ndarray, several: np.ndarray) -> bytes:
    low = (cells & _U(0xFFFFFFFF)).astype(np.uint32)
    step = np.diff(low, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T  # planes compress better
    return zstandard.ZstdCompressor(level=3).compress(np.int64(len(low)).tobytes() + step.tobytes() + several.tobytes())


def _unsqueeze(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    planes = np.frombuffer(raw, np.uint8, 4 * n, 8).reshape(4, n)
    low = np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)
    return low, np.frombuffer(raw, np.bool_, -1, 8 + 4 * n) if len(raw) > 8 + 4 * n else np.zeros(0, bool)


_TOLD = pa.schema([("bucket", pa.int32()), ("group", pa.int32()), ("blob", pa.binary())])
_TOLD_DDL = "bucket int, group int, blob binary"
_HEARD_DDL = "__group int, bucket int, blob binary"


def _answer(told: pa.Table) -> pa.Table:
    """The hashes of a bucket that two documents have, to each group that has them."""
    parts = [_unsqueeze(b.as_py()) for b in told.column("blob")]
    values, which, groups = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True, return_counts=True)
    common = groups > 1
    np.logical_or.at(common, which, np.concatenate([p[1] for p in parts]))
    ends = np.cumsum([len(p[0]) for p in parts])
    out = []
    for (low, _), end in zip(parts, ends):
        held = low[common[which[end - len(low):end]]]
        out.append(_squeeze(held.astype(_U), np.zeros(0, bool)) if len(held) else None)
    answer = pa.table([told.column("group"), told.column("bucket"), pa.array(out, pa.binary())], names=["__group", "bucket", "blob"])
    return answer.filter(answer.column("blob").is_valid())


# --- 2: runs that may repeat ----------------------------------------------------------------

def _scatter(window: int, buckets: int, splits: list[int], common: np.ndarray):
    """A group and the answers to it, to packed runs by bucket and batch."""
    edges = np.array(splits, np.int64)

    def piece_entries(body, part, eight, runs, side, known, doc, key, group, held):
        left, before, after = side
        first = _held(known, _cells(before, buckets)) & (left > 0)
        second = _held(known, _cells(after, buckets)) & (left < runs.count)
        start = np.where(first, runs.start, runs.start + left)
        stop = np.where(second, runs.start + runs.count, runs.start + left)
        some = np.flatnonzero(stop > start)
        if not len(some):
            return
        runs = Runs(start[some], (stop - start)[some], runs.anchor_at[some], runs.anchor[some])
        deal = runs.anchor
        hot = np.isin(runs.anchor, common)
        if hot.any():
            cold, sub = runs.take(~hot), split_runs(runs, hot)
            # All windows of a part share the bytes from its last start to the end of its first.
            last = sub.anchor_at - (sub.anchor_at - sub.start) // SUB_RUN * SUB_RUN
            core = string_hashes(eight, last, window - SUB_RUN + 1)
            runs = Runs(*(np.concatenate([getattr(cold, f), getattr(sub, f)]) for f in ("start", "count", "anchor_at", "anchor")))
            deal = np.concatenate([cold.anchor, text.mixed(sub.anchor ^ core)])
        row = np.searchsorted(part, runs.start, side="right") - 1
        same = text.mixed(
            string_hashes(eight, runs.start, window) * _U(3)
            + string_hashes(eight, runs.start + runs.count - 1, window) * _U(5)
            + runs.count.astype(_U) * _U(7) + (runs.anchor_at - runs.start).astype(_U))
        order = np.lexsort((doc[row], same))
        fresh = np.ones(len(order), bool)
        fresh[1:] = same[order][1:] != same[order][:-1]
        lowest = doc[row][order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        whole = np.zeros(len(order), bool)
        whole[order] = doc[row][order] > lowest
        code = (deal >> _U(20)) % _U(buckets) * _U(len(edges) + 1) + np.searchsorted(edges, doc[row]).astype(_U)
        order = np.lexsort((runs.start, row, code))
        code, row, whole = code[order].astype(np.int64), row[order], whole[order]
        runs = runs.take(order)
        sent = np.where(whole, 0, runs.count + window - 1)
        strings = gather(body, runs.start, sent).tobytes()
        ends = np.cumsum(sent)
        fields = {"doc": doc[row], "key": key[row], "group": np.full(len(row), group, np.int32),
                  "start": runs.start - part[row], "count": runs.count, "whole": whole}
        heads = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        for a, b in zip(heads, np.append(heads[1:], len(code))):
            held.setdefault(int(code[a]), []).append((
                {k: v[a:b] for k, v in fields.items()}, strings[ends[a] - sent[a]:ends[b - 1]]))

    def run(rows: pa.Table, heard: pa.Table) -> pa.Table:
        answers = [(np.int64(b.as_py()) << np.int64(32)) | _unsqueeze(v.as_py())[0].astype(np.int64)
                   for b, v in zip(heard.column("bucket"), heard.column("blob"))]
        held: dict[int, list] = {}
        if answers and rows.num_rows:
            rows = _usable(rows)
            known = np.sort(np.concatenate(answers).view(_U))
            doc, key = rows.column("doc_id").to_numpy(), rows.column("__key").to_numpy()
            group = heard.column("__group")[0].as_py()
            for body, part, a, b, eight, runs, side in _group_pieces(rows, window):
                piece_entries(body, part, eight, runs, side, known, doc[a:b], key[a:b], group, held)
        blobs = []
        for code in sorted(held):
            parts = held[code]
            fields = {k: np.concatenate([p[0][k] for p in parts]) for k, _ in _PARTS}
            blobs.append((code // (len(edges) + 1), code % (len(edges) + 1), pack(fields, b"".join(p[1] for p in parts))))
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*blobs), _BLOBS)] if blobs
                        else [pa.array([], f.type) for f in _BLOBS], schema=_BLOBS)

    return run


def _held(ordered: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(asked), bool)
    return ordered[np.minimum(np.searchsorted(ordered, asked), len(ordered) - 1)] == asked


_BLOBS = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), ("blob", pa.binary())])
_BLOBS_DDL = "bucket int, batch int, blob binary"


def _common_anchors(docs: DataFrame, window: int) -> np.ndarray:
    """Anchors of a large share of the documents, from a hashed share of them."""
    def anchors(batches):
        for batch in batches:
            data, offsets = text.column_bytes(batch.column(0))
            for a, b in text.pieces(data, offsets):
                part = offsets[a:b + 1] - offsets[a]
                runs = find_runs(eights(data[offsets[a]:offsets[b]]), part, window)
                row = np.searchsorted(part, runs.start, side="right") - 1
                seen = np.unique(np.stack([runs.anchor, row.astype(_U)], 1), axis=0)[:, 0]
                values, counts = np.unique(seen, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64)), pa.array(np.where(np.arange(len(values)) == 0, b - a, 0))], names=["anchor", "n", "docs"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("anchors")), F.lit(COMMON_SHARE)) == 0).select("text")
    counted = cut(some.mapInArrow(anchors, "anchor long, n long, docs long").groupBy("anchor").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    total = counted.agg(F.sum("docs")).first()[0] or 0
    rows = counted.where(F.col("n") > max(20, total * COMMON)).select("anchor").collect()
    return np.array(sorted(r[0] for r in rows), np.int64).view(_U)


# --- the index family of a bucket ----------------------------------------------------------

@dataclass
class Level:
    """A suffix array: the fingerprints of its suffixes' windows in order, each once, with the
    smallest document that has it."""

    suffix: np.ndarray
    doc: np.ndarray


def suffix_array(suffix: np.ndarray, doc: np.ndarray) -> Level:
    order = np.argsort(suffix, kind="stable")
    suffix, doc = suffix[order], doc[order]
    heads = np.flatnonzero(np.append(True, suffix[1:] != suffix[:-1])) if len(suffix) else np.zeros(0, int)
    return Level(suffix[heads], np.minimum.reduceat(doc, heads) if len(heads) else doc)


class IndexFamily:
    """Levels of geometrically falling size; batches come with ascending document ids."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, suffix: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which windows of a batch start in an earlier document too. The batch is then part
        of the family."""
        new = suffix_array(suffix, doc)
        lowest, known = new.doc.copy(), np.zeros(len(new.doc), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level.suffix, new.suffix), len(level.suffix) - 1)
            hit = level.suffix[at] == new.suffix
            lowest[hit] = np.minimum(lowest[hit], level.doc[at[hit]])
            known |= hit & (level.doc[at] <= new.doc)
        self._insert(Level(new.suffix[~known], new.doc[~known]))
        return lowest[np.searchsorted(new.suffix, suffix)] < doc

    def _insert(self, level: Level) -> None:
        if len(level.suffix):
            self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-2].suffix) < 2 * len(self.levels[-1].suffix):
            last, before = self.levels.pop(), self.levels.pop()
            self.levels.append(suffix_array(
                np.concatenate([before.suffix, last.suffix]), np.concatenate([before.doc, last.doc])))


def _batch_ranges(family: IndexFamily, blobs: list[bytes], window: int) -> dict[str, np.ndarray]:
    """Removed byte ranges of a batch: ``group, doc, key, start, end``."""
    parts = [unpack(b) for b in blobs]
    fields = {k: np.concatenate([p[0][k] for p in parts]) for k, _ in _PARTS}
    body = np.concatenate([p[1] for p in parts])
    count, whole = fields["count"].astype(np.int64), fields["whole"]
    start = fields["start"].astype(np.int64)
    out = [(np.flatnonzero(whole), start[whole], start[whole] + count[whole] + window - 1)]
    entry = np.flatnonzero(~whole)
    if len(entry):
        count = count[entry]
        length = count + window - 1
        own = np.repeat(np.arange(len(entry)), count)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        at = (np.cumsum(length) - length)[own] + inner
        again = family.add(string_hashes(eights(body), at, window), fields["doc"][entry][own])
        if again.any():
            own, inner = own[again], inner[again]
            fresh = np.append(True, (own[1:] != own[:-1]) | (inner[1:] != inner[:-1] + 1))
            heads = np.flatnonzero(fresh)
            tails = np.append(heads[1:], len(own)) - 1
            who = entry[own[heads]]
            out.append((who, start[who] + inner[heads], start[who] + inner[tails] + window))
    which = np.concatenate([o[0] for o in out])
    return {"group": fields["group"][which], "doc": fields["doc"][which], "key": fields["key"][which],
            "start": np.concatenate([o[1] for o in out]), "end": np.concatenate([o[2] for o in out])}


def _index(window: int):
    """Packed runs, ordered by bucket and batch, to packed removed ranges by document group."""
    def pack_ranges(kept):
        if not kept:
            return
        r = {k: np.concatenate([x[k] for x in kept]) for k in kept[0]}
        order = np.lexsort((r["start"], r["key"], r["doc"], r["group"]))
        r = {k: v[order] for k, v in r.items()}
        heads = np.flatnonzero(np.append(True, r["group"][1:] != r["group"][:-1]))
        ends = np.append(heads[1:], len(order))
        blobs = [zstandard.ZstdCompressor(level=3).compress(
            b"".join(r[k][a:b].astype(np.int64).tobytes() for k in ("doc", "key", "start", "end"))) for a, b in zip(heads, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(r["group"][heads].astype(np.int32)), pa.array(blobs, pa.binary())], names=["group", "ranges"])

    def run(batches):
        now, family, blobs, kept, held = None, None, [], [], 0

        def close():
            if blobs:
                r = _batch_ranges(family, blobs, window)
                if len(r["doc"]):
                    kept.append(r)
            return sum(len(x["doc"]) for x in kept)

        for batch in batches:
            for bucket, number, blob in zip(*(batch.column(i) for i in range(3))):
                at = (bucket.as_py(), number.as_py())
                if at != now:
                    held = close()
                    blobs = []
                    if now is None or at[0] != now[0]:
                        family = IndexFamily()
                        if held > 500_000:
                            yield from pack_ranges(kept)
                            kept.clear()
                    now = at
                blobs.append(blob.as_py())
        close()
        yield from pack_ranges(kept)

    return run


# --- 3: back at the documents --------------------------------------------------------------

def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of ``n`` bytes the ranges cover."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, start, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth)[:n] > 0


def _apply(schema: pa.Schema, as_text: bool):
    def run(rows: pa.Table, ranges: pa.Table) -> pa.Table:
        marks = {}
        packed = [zstandard.ZstdDecompressor().decompress(b.as_py()) for b in ranges.column("__ranges")]
        if packed:
            parts = [np.frombuffer(p, np.int64).reshape(4, -1) for p in packed]
            doc, key, start, end = np.concatenate(parts, axis=1)
            order = np.lexsort((key, doc))
            doc, key, start, end = doc[order], key[order], start[order], end[order]
            heads = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]))) if len(doc) else []
            for a, b in zip(heads, np.append(heads[1:], len(doc))):
                marks[(int(doc[a]), int(key[a]))] = (start[a:b], end[a:b])
        data, offsets = text.column_bytes(rows.column("text"))
        sizes, removed, spans, kept = [], [], [], []
        for i, at in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("__key").to_pylist())):
            body = data[offsets[i]:offsets[i + 1]]
            gone = cover(len(body), *marks[at]) if at in marks else np.zeros(len(body), bool)
            sizes.append(len(body))
            removed.append(int(gone.sum()))
            spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            left = body[~gone].tobytes()
            kept.append(left.decode("utf-8", "ignore") if as_text else left)
        columns = [rows.column(f.name) for f in list(schema)[:-4]] + [
            pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, schema.field(len(schema) - 1).type)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def remove_repeats(docs: DataFrame, window: int = 50, batches: int = BATCHES, as_text: bool = False) -> DataFrame:
    """All columns of ``docs`` and ``sa_bytes, sa_removed, sa_spans`` (counts) and ``sa_kept``
    (the bytes that stay; with ``as_text`` a string, without what a cut has left of a
    character)."""
    nameless, docs = docs.where(F.col("doc_id").isNull()), docs.where(F.col("doc_id").isNotNull())
    shape = docs.agg(
        F.sum(F.octet_length("text")), F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)
    ).first()
    total = shape[0] or 0
    splits = sorted(set(shape[1] or []))
    groups, buckets = max(1, total // GROUP_BYTES), max(1, total // BUCKET_BYTES)
    rows = docs.withColumns({
        "doc_id": F.col("doc_id").cast("long"), "__key": F.xxhash64(F.coalesce("text", F.lit(""))),
        "__group": F.pmod(F.xxhash64("doc_id", F.lit("group")), F.lit(groups)).cast("int"),
    }).repartition(groups, "__group")
    told = rows.groupBy("__group").applyInArrow(_announce(window, buckets), _TOLD_DDL)
    heard = told.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_answer, _HEARD_DDL)
    blobs = rows.groupBy("__group").cogroup(heard.repartition(groups, "__group").groupBy("__group")).applyInArrow(
        _scatter(window, buckets, splits, _common_anchors(docs, window)), _BLOBS_DDL)
    ranges = (
        blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket", "batch")
        .mapInArrow(_index(window), "group int, ranges binary").toDF("__group", "__ranges")
    )
    out = T.StructType(docs.schema.fields + [
        T.StructField("sa_bytes", T.LongType()), T.StructField("sa_removed", T.LongType()),
        T.StructField("sa_spans", T.LongType()), T.StructField("sa_kept", T.StringType() if as_text else T.BinaryType())])
    done = rows.groupBy("__group").cogroup(
        ranges.repartition(groups, "__group").groupBy("__group")).applyInArrow(_apply(to_arrow_schema(out), as_text), out)
    whole = F.coalesce("text", F.lit(""))
    return done.unionByName(nameless.withColumns({
        "sa_bytes": F.octet_length(whole).cast("long"), "sa_removed": F.lit(0).cast("long"),
        "sa_spans": F.lit(0).cast("long"), "sa_kept": whole if as_text else whole.cast("binary")}))
