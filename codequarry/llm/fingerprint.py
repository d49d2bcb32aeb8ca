"""Document fingerprints by randomised edit embedding.

All texts walk with the same random bits: at step ``j`` the character under the pointer is
emitted, and the pointer moves on if bit ``(j, character)`` is set. Two texts with few edits
between them drift apart at an edit and meet again soon, so the Hamming distance of what they
emit follows their edit distance. Walks have three steps for each character.

A fingerprint samples ``SLOTS`` steps of the walk. Slot ``k`` takes, of the steps that the walk
has, the one that comes first in the slot's own random order, so texts of nearly equal length
sample the same steps. A sampled step gives one byte, a hash of the ``LOOK`` characters from
the pointer on, or zero past the end. Likeness is the share of equal slots, those of two
ended walks left out.

:func:`near_pairs` bands the sampled slots, compares the documents that share a band, and
verifies the links on the full fingerprints and, where asked, on the edit distance of the texts.

Defined results: a null text is empty; an empty text has a fingerprint of its own, all zeros.
Equal texts have equal fingerprints. Whole texts are walked. Repeated rows are rows of their
own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from ..plans.checkpoints import cut
from .components import components
from .text import TaskCache, mixed

SLOTS = 128
STEPS = 3
#: Rows of the table of random bits; steps use them in turn.
BIT_ROWS = 4093
#: Walks that go on together in numpy; below, each goes on by itself.
TOGETHER = 48
CHUNK = 3 << 20
#: Characters that a sampled step looks at.
LOOK = 5
#: Texts of a bucket that are all compared with each other, and of a block of a larger one.
SMALL_BUCKET, BLOCK = 16, 1000
RANGE_BYTES, MOST_RANGES = 8 << 20, 20_000
_NEIGHBOUR = "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next"

_cache = TaskCache()


def random_bits() -> np.ndarray:
    """Shared bits by step (modulo ``BIT_ROWS``) and character class."""
    if "bits" not in _cache:
        _cache["bits"] = np.random.default_rng(31).integers(0, 2, (BIT_ROWS, 256), dtype=np.uint8)
    return _cache["bits"]


def slot_steps(most: int) -> list[list[int]]:
    """For each slot the steps that become its choice as walks grow longer, ascending, up to
    ``most``: the record minima of the slot's random order of all steps."""
    if _cache.get("records", (0,))[0] < most:
        # Of random orders only the record minima matter; they are drawn directly: a new record
        # comes after a geometric gap, and lies evenly below the one before.
        records = []
        for k in range(SLOTS):
            rng = np.random.default_rng([17, k])
            step, low, run = 0, rng.random(), [0]
            while True:
                step += int(min(rng.geometric(max(low, 1e-15)), 1 << 50))
                low *= rng.random()
                if step > most:
                    break
                run.append(step)
            records.append(run)
        _cache["records"] = (most, records)
    return _cache["records"][1]


def characters(value: str) -> np.ndarray:
    return np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprints(texts: list[str]) -> list[bytes]:
    """``SLOTS`` bytes for each text."""
    out = np.zeros((len(texts), SLOTS), np.uint8)
    order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        size, end = 0, at
        while end < len(order) and (end == at or size + len(texts[order[end]]) <= CHUNK):
            size += len(texts[order[end]])
            end += 1
        out[order[at:end]] = _walk([characters(texts[i]) for i in order[at:end]])
        at = end
    return [row.tobytes() for row in out]


def _walk(texts: list[np.ndarray]) -> np.ndarray:
    """Fingerprints of non-empty texts, longest first."""
    bits = random_bits()
    lengths = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(lengths + LOOK)])
    code = np.zeros(int(begin[-1]) + LOOK, np.uint32)
    for t, b in zip(texts, begin):
        code[b:b + len(t)] = t + np.uint32(1)  # so that no character is zero
    # Texts end in zeros; a walk that has passed the end emits zeros from then on.
    kind = (code ^ (code >> np.uint32(8)) * np.uint32(31)).astype(np.uint8)
    word = code * np.uint32(0x85EBCA6B)
    for k in range(1, LOOK):
        word[:-k] = word[:-k] + code[k:] * np.uint32((0x85EBCA6B * (2 * k + 1) + (k << 16)) & 0xFFFFFFFF | 1)
    word = (word ^ (word >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    symbol = (word % np.uint32(255) + np.uint32(1)).astype(np.uint8)
    symbol[code == 0] = 0
    steps = lengths * STEPS
    records = slot_steps(int(steps[0]))
    wanted = sorted({r for rec in records for r in rec if r < steps[0]})
    column = {r: i for i, r in enumerate(wanted)}
    taken = np.zeros((len(texts), len(wanted)), np.uint8)
    place = begin[:-1].copy()
    end = begin[:-1] + lengths
    stop = np.searchsorted(-steps, -np.arange(int(steps[0]) + 1), side="left")  # walks with more steps than j
    j, due = 0, 0
    last = int(steps[min(TOGETHER, len(texts)) - 1]) if len(texts) >= TOGETHER else 0
    while j < last:
        active = int(stop[j])
        here = place[:active]
        if due < len(wanted) and wanted[due] == j:
            taken[:active, due] = symbol[here]
            due += 1
        here += bits[j % BIT_ROWS][kind[here]]
        np.minimum(here, end[:active], out=here)
        j += 1
    for t in range(int(stop[j]) if j < len(stop) else 0):
        taken[t, due:] = _walk_alone(kind, symbol, int(place[t]), int(end[t]), j, int(steps[t]), wanted[due:], bits)
    out = np.zeros((len(texts), SLOTS), np.uint8)
    for k, rec in enumerate(records):
        choice = np.searchsorted(np.array(rec), steps, side="left") - 1
        out[:, k] = taken[np.arange(len(texts)), [column[rec[c]] for c in choice]]
    return out


def _walk_alone(kind, symbol, place, end, j, steps, wanted, bits) -> np.ndarray:
    """The rest of one walk, from step ``j`` on."""
    out = np.zeros(len(wanted), np.uint8)
    table = _cache.setdefault("rows", [r.tobytes() for r in bits])
    kinds, base = kind[place:end + 1].tobytes(), place
    place, end = 0, end - base
    for i, goal in enumerate(wanted):
        if goal >= steps:
            break
        while j < goal and place < end:
            place += table[j % BIT_ROWS][kinds[place]]
            j += 1
        out[i] = symbol[base + place]
        if place >= end:
            break
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal slots of two fingerprints, of those in which one of the walks was still
    in its text, corrected so that chance gives 0. Two empty texts are alike."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    inside = (x > 0) | (y > 0)
    if not inside.any():
        return 1.0
    equal = (x == y)[inside].mean()
    return float(max(0.0, (equal - 1 / 255) / (1 - 1 / 255)))


def likenesses(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([likeness(x, y) if x is not None and y is not None else 0.0 for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def with_fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """``docs`` and the fingerprint of ``text`` as ``SLOTS`` bytes."""
    @arrow_udf(T.BinaryType())
    def of(values: pa.Array) -> pa.Array:
        return pa.array(fingerprints([v or "" for v in values.to_pylist()]), pa.binary())

    return docs.withColumn(name, of.asNondeterministic()(F.col("text")))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel over the shorter text."""
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if not m:
        return len(b)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    top, full = 1 << m - 1, (1 << m) - 1
    up, down, score = full, 0, m
    for c in b:
        eq = masks.get(c, 0)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq | down
        hp, hn = down | (~(d | up) & full), up & d
        score += bool(hp & top) - bool(hn & top)
        hp = (hp << 1 | 1) & full
        hn = hn << 1 & full
        up, down = hn | (~(x | hp) & full), hp & x
    return score


def _band_keys(bands: int):
    """Keys of the bands of a fingerprint. Slots of ended walks are equal between all texts, so a
    band with less than three others takes the next band with it, and has no key if that
    does not help."""
    @arrow_udf(T.ArrayType(T.LongType()))
    def keys(marks: pa.Array) -> pa.Array:
        width = SLOTS // bands
        slots = _slots(marks)[:, :bands * width].reshape(-1, bands, width).astype(np.uint64)
        said = (slots > 0).sum(axis=2)
        least = min(3, width)
        own = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(slots), 1))
        for k in range(width):
            own = mixed(own) + slots[:, :, k]
        both = mixed(own)
        for k in range(width):
            both = mixed(both) + np.roll(slots, -1, axis=1)[:, :, k]
        key = mixed(np.where(said >= least, own, both)).view(np.int64)
        use = said + np.where(said >= least, 0, np.roll(said, -1, axis=1)) >= least
        cuts = np.concatenate([[0], np.cumsum(use.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(cuts, pa.array(key[use]))

    return keys


def _slots(marks: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(marks.to_pylist()), np.uint8).reshape(-1, SLOTS)


def _all_likenesses(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """:func:`likeness` of every row of ``x`` with every row of ``y``."""
    equal, ended = (np.zeros((len(x), len(y)), np.int16) for _ in range(2))
    for k in range(SLOTS):
        same = x[:, k, None] == y[None, :, k]
        none = x[:, k] == 0
        equal += same
        equal[none] -= same[none]
        ended[none] += same[none]
    inside = SLOTS - ended
    share = equal / np.maximum(inside, 1)
    return np.where(inside > 0, np.maximum(0.0, (share - 1 / 255) / (1 - 1 / 255)), 1.0)


def _alike_across(least: float):
    """Rows of two blocks of fingerprints to the pairs across components that are alike."""
    def run(batches):
        for batch in batches:
            for minor, other in zip(batch.column(0), batch.column(1)):
                (na, ca, fa), (nb, cb, fb) = (
                    (v.field("node").to_numpy(), v.field("c").to_numpy(), _slots(v.field("fp"))) for v in (minor.values, other.values))
                i, j = np.nonzero((_all_likenesses(fa, fb) >= least) & (ca[:, None] != cb[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(na[i], nb[j])), pa.array(np.minimum(na[i], nb[j]))], names=["a", "b"])

    return run


def _across(large: DataFrame, pivots: DataFrame, alike: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """All alike pairs ``a, b`` across components of texts whose large buckets hang together: what
    such a group has outside its largest component is compared with all of it, block by block."""
    groups = components(large.join(pivots, "key").select(F.greatest("node", "p").alias("a"), F.least("node", "p").alias("b")))
    held = cut(
        groups.toDF("node", "g").join(components(links).toDF("node", "c"), "node", "left")
        .withColumn("c", F.coalesce("c", "node"))
    )
    parts = held.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m"))
    opened = parts.groupBy("g").agg(
        F.max(F.struct("m", "c")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("m").alias("m"),
    ).where("parts > 1").select("g", F.col("top.c").alias("top"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = cut(
        held.join(opened, "g").join(alike.select("node", "fp"), "node")
        .select("g", "c", "top", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node", "fp")
    )
    item = F.struct("node", "c", "fp")
    whole = rows.groupBy("g", "block").agg(F.collect_list(item).alias("other"))
    minor = (
        rows.where("c <> top").groupBy("g", F.col("block").alias("mine"), "blocks").agg(F.collect_list(item).alias("minor"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    return minor.join(whole, ["g", "block"]).select("minor", "other").mapInArrow(_alike_across(least), "a long, b long")


def near_pairs(docs: DataFrame, least: float = 0.8, bands: int = 32, most_edits: float | None = None) -> DataFrame:
    """``doc_id, other_id, likeness``: pairs of documents that are alike, the larger id first.

    Sampled slots are split into ``bands``; texts with an equal band share its bucket. A bucket of
    at most ``SMALL_BUCKET`` texts gives all its pairs. In a larger one every text is compared
    with a pivot, the one with the fullest buckets, and what this leaves outside the largest
    component is compared with all of them. Pairs of a likeness of at least ``least`` stay; with
    ``most_edits`` also their edit distance must be at most that share of the longer text.

    So documents that share a bucket and are alike are always in one component of the pairs, and
    are a pair themselves unless all their buckets are large. Equal texts are represented by
    their smallest id, and the others are paired with that alone."""
    said = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = said.withColumn("node", F.xxhash64("text"))
    texts = named.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("text").alias("text"))
    alike = cut(with_fingerprint(texts, "fp").select("node", "rep", "fp"))
    keyed = alike.select("node", F.explode(_band_keys(bands)("fp")).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut(keyed.join(sizes, "key"))
    small, large = members.where(F.col("size") <= SMALL_BUCKET), members.where(F.col("size") > SMALL_BUCKET)
    popular = members.groupBy("node").agg(F.sum("size").alias("pop"))
    pivots = cut(large.join(popular, "node").groupBy("key").agg(F.max(F.struct("pop", "node")).alias("s")).select("key", F.col("s.node").alias("p")))
    asked = (
        small.select("key", F.col("node").alias("a")).join(small.select("key", F.col("node").alias("b")), "key").where("a > b").select("a", "b")
        .unionByName(large.join(pivots, "key").select(F.greatest("node", "p").alias("a"), F.least("node", "p").alias("b")).where("a <> b"))
        .distinct()
    )
    compare = arrow_udf(likenesses, T.DoubleType())

    def verified(pairs: DataFrame) -> DataFrame:
        both = (
            pairs.join(alike.toDF("a", "ra", "fa"), "a").join(alike.toDF("b", "rb", "fb"), "b")
            .withColumn("likeness", compare("fa", "fb")).where(F.col("likeness") >= least).drop("fa", "fb")
        )
        if most_edits is None:
            return both
        few = arrow_udf(lambda x, y: pa.array(
            [edit_distance(s, t) <= most_edits * max(len(s), len(t)) for s, t in zip(x.to_pylist(), y.to_pylist())], pa.bool_()), T.BooleanType())
        side = texts.select("node", "text")
        return both.join(side.toDF("a", "ta"), "a").join(side.toDF("b", "tb"), "b").where(few("ta", "tb")).drop("ta", "tb")

    links = cut(verified(asked))
    rest = verified(_across(large.select("key", "node"), pivots, alike, links.select("a", "b"), least).distinct())
    linked = links.unionByName(rest, allowMissingColumns=False).where("ra <> rb").select(
        F.greatest("ra", "rb").alias("doc_id"), F.least("ra", "rb").alias("other_id"), "likeness").distinct()
    copies = named.join(alike, "node").where("doc_id <> rep").select(
        "doc_id", F.col("rep").alias("other_id"), F.lit(1.0).alias("likeness"))
    return linked.unionByName(copies)


def with_neighbour(docs: DataFrame) -> DataFrame:
    """For every document: its fingerprint, that of its text with the second half replaced by
    the beginning of the next document's, and how like both and the next document's are.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. The
    next document is the one with the next larger id (ties by a hash of the text), after the
    last one the first. Documents are dealt by ranges of ids and each range is read in order
    in one task, a piece at a time; the first document of a range is sent to the range before
    as well. Of a range only the first id is broadcast, and there are ``MOST_RANGES`` at most."""
    shape = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    ranges = int(min(MOST_RANGES, max(1, (shape[0] or 0) // RANGE_BYTES)))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], max(1000, 10 * ranges))).first()[0] if ranges > 1 else None
    edges = np.array(sorted(set(cuts or [])), np.int64)

    @arrow_udf(T.IntegerType())
    def range_of(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, ids.fill_null(-2**63).to_numpy(zero_copy_only=False)).astype(np.int32))

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("text").alias("tie"), range_of(F.col("doc_id").cast("long")).alias("range"))
    firsts = sorted(
        (r["range"], r["s"]["doc_id"], r["s"]["tie"]) for r in
        rows.groupBy("range").agg(F.min(F.struct("doc_id", "tie")).alias("s")).collect())
    if not firsts:
        firsts = [(0, None, 0)]
    before = {r[0]: firsts[k - 1][0] for k, r in enumerate(firsts)}
    heads = F.broadcast(docs.sparkSession.createDataFrame(
        [(r, i, t, before[r]) for r, i, t in firsts], "hr int, hi long, ht long, before int"))
    dealt = rows.join(heads, (rows["range"] == heads["hr"]) & rows["doc_id"].eqNullSafe(heads["hi"]) & (rows["tie"] == heads["ht"]), "left")
    both = dealt.select("doc_id", "text", "tie", F.explode(F.when(
        F.col("hr").isNull(), F.array(F.struct(F.col("range").alias("r"), F.lit(False).alias("guest")))
    ).otherwise(F.array(
        F.struct(F.col("range").alias("r"), F.lit(False).alias("guest")),
        F.struct(F.col("before").alias("r"), F.lit(True).alias("guest"))))).alias("to"))
    ordered = (
        both.select("to.r", "to.guest", "doc_id", "tie", "text")
        .repartition(len(firsts), "r").sortWithinPartitions("r", "guest", "doc_id", "tie")
    )

    def measure(rows: list[tuple], follower: tuple | None) -> pa.RecordBatch:
        own = [(i, r) for i, r in enumerate(rows) if not r[1]]
        after = [*rows[1:], follower]
        edited = [r[4][:len(r[4]) - len(r[4]) // 2] + after[i][4][:len(r[4]) // 2] for i, r in own]
        marks = fingerprints([r[4] for r in rows] + ([follower[4]] if follower else []) + edited)
        mine = [marks[i] for i, _ in own]
        changed = marks[len(marks) - len(edited):]
        follow = [marks[i + 1] for i, _ in own]
        return pa.RecordBatch.from_arrays([
            pa.array([r[2] for _, r in own], pa.int64()), pa.array([len(r[4]) for _, r in own], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array([m.hex() for m in mine], pa.string()), pa.array([m.hex() for m in changed], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(mine, changed)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(mine, follow)], pa.float64()),
        ], names=_NEIGHBOUR.split())

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[4])
                if size > CHUNK and len(held) > 1:
                    yield measure(held[:-1], held[-1])
                    held, size = held[-1:], len(row[4])
        if held:
            yield measure(held, None)

    kinds = ("long", "long", "string", "string", "string", "double", "double")
    return ordered.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(_NEIGHBOUR.split(), kinds)))
