"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

Every text becomes the set of its distinct word shingles and a signature of ``SLOTS``
16-bit MinHash values. Two signatures are at the distance of the slots in which they
differ. The slots are split into ``CHUNKS`` chunks; by the pigeonhole principle a pair at
a distance of at most ``2 * CHUNKS - 1`` has a chunk with at most one error, and that error
is enumerated: each chunk gives one key for each slot left out. Sharing a key is therefore
guaranteed for all pairs within the distance; two sets with a similarity of 0.8 share none
with a chance of about one in a million. Pairs that share a key and are near enough by
signature are confirmed on their full sets, exactly.

Groups of copies never expand into all pairs:

* Equal sets are one class from the start; only class representatives are joined.
* A bucket (one key) of few members gives its pairs. In a larger one every member is
  compared with a pivot, the member with the fullest buckets: the text that the copies
  were made from agrees with all of them.
* What such buckets have outside the largest component is then compared with the rest, in
  blocks of bounded size by matrix products over their shingles, which give exact
  intersection sizes; only similar pairs become rows. Links inside a component do not change
  it, so no link that matters can be missing.

Defined results: a null or empty text, or one of white space, has an empty set and is
linked with nothing. Fewer words than a shingle are one shingle. A row without id is kept
and linked with nothing (component null). Rows of one id are one document, linked by
each of its texts; repeated rows get equal results. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from . import text
from ..plans.checkpoints import cut, cut_counted, forget
from .components import components

CHUNKS, CHUNK_SLOTS = 8, 4
SLOTS = CHUNKS * CHUNK_SLOTS
SMALL_BUCKET = 16
#: Ids (of eight bytes) that may be sent to every task; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: About how many shingles and sets make a block, and how many shingles are compared at once.
BLOCK_SHINGLES, BLOCK_SETS, COLUMNS = 1 << 19, 1000, 2048
#: Share of a block's pairs from which on a shingle is counted in the matrix product, and
#: pairs that are counted one by one at once.
DENSE, PAIRS = 1 / 200, 2_000_000

_rng = np.random.default_rng(8)
_SLOT_XOR = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64)
_SLOT_MUL = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text of a piece."""
    data = text.LOWER[data]
    starts, ends = text.token_bounds((~text.SPACE[data]).astype(np.uint8), offsets)
    word = text.SpanHash(data)(starts, ends)
    first = text.per_text(starts, offsets)
    full = max(0, len(word) - words + 1)
    rolled = np.zeros(full, np.uint64)
    for k in range(words):
        rolled = rolled * _STEP + word[k:k + full]
    rolled = text.mixed(rolled)
    sets = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            sets.append(np.unique(rolled[a:b - words + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                whole = text.mixed(whole * _STEP + word[k:k + 1])
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """``SLOTS`` 16-bit MinHash values of every set (zeros for an empty one)."""
    out = np.zeros((len(sets), SLOTS), np.uint16)
    full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
    if not len(full):
        return out
    joined = np.concatenate([sets[i] for i in full])
    heads = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
    for k in range(SLOTS):
        low = np.minimum.reduceat((joined ^ _SLOT_XOR[k]) * _SLOT_MUL[k], heads)
        out[full, k] = (text.mixed(low) >> np.uint64(48)).astype(np.uint16)
    return out


def _by_piece(values: pa.Array, words: int):
    data, offsets = text.column_bytes(values)
    for a, b in text.pieces(data, offsets):
        yield shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], words)


def _digest_udf(words: int):
    @arrow_udf("struct<n: long, h1: long, h2: long, sig: binary>")
    def digest(values: pa.Array) -> pa.Array:
        n, h1, h2, sigs = [], [], [], []
        for sets in _by_piece(values, words):
            n += [len(s) for s in sets]
            with np.errstate(over="ignore"):
                h1 += [int(np.sum(text.mixed(s)).astype(np.int64)) for s in sets]
                h2 += [int(np.sum(text.mixed(s ^ _STEP)).astype(np.int64)) for s in sets]
            sigs += [s.tobytes() for s in signatures(sets)]
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.binary())],
            names=["n", "h1", "h2", "sig"])

    return digest.asNondeterministic()


def _sets_udf(words: int):
    @arrow_udf("array<long>")
    def full_sets(values: pa.Array) -> pa.Array:
        sets = [s for part in _by_piece(values, words) for s in part]
        cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        body = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        return pa.ListArray.from_arrays(cuts, pa.array(body.view(np.int64)))

    return full_sets


def _slots(column: pa.Array) -> np.ndarray:
    data, _ = text.column_bytes(column)
    return np.frombuffer(data.tobytes(), np.uint16).reshape(-1, SLOTS).astype(np.uint64)


@arrow_udf(T.ArrayType(T.LongType()))
def _keys(sigs: pa.Array) -> pa.Array:
    slots = _slots(sigs).reshape(-1, CHUNKS, CHUNK_SLOTS)
    out = np.zeros((len(slots), SLOTS), np.uint64)
    for c in range(CHUNKS):
        for gone in range(CHUNK_SLOTS):
            key = np.full(len(slots), c * CHUNK_SLOTS + gone, np.uint64)
            for s in range(CHUNK_SLOTS):
                if s != gone:
                    key = (key << np.uint64(16)) | slots[:, c, s]
            out[:, c * CHUNK_SLOTS + gone] = key
    cuts = (np.arange(len(slots) + 1) * SLOTS).astype(np.int32)
    return pa.ListArray.from_arrays(cuts, pa.array(out.ravel().view(np.int64)))


@arrow_udf(T.IntegerType())
def _distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array((_slots(a) != _slots(b)).sum(axis=1).astype(np.int32))


def _comparable(na: str, nb: str, percent: int):
    """Sizes with which the asked similarity is possible at all."""
    return (100 * F.least(na, nb)) >= (percent * F.greatest(na, nb))


def _near_enough(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose sizes allow a link, with their signature distance."""
    side = classes.select("rep", "n", "sig")
    return (
        pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
        .where(_comparable("na", "nb", percent))
        .select("a", "b", _distance("sa", "sb").alias("d"))
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    both = (
        pairs.select("a", "b").join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        .select("a", "b", (F.size("sa") + F.size("sb")).cast("long").alias("total"),
                F.size(F.array_intersect("sa", "sb")).cast("long").alias("common"))
    )
    # An id with several texts has several sets; any two that are alike link the ids.
    return both.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b").distinct()


def _apart(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs whose nodes are not of one component yet."""
    return (
        pairs.join(placed.toDF("a", "ca"), "a", "left").join(placed.toDF("b", "cb"), "b", "left")
        .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(pairs.columns)
    )


def _matches(percent: int):
    """Rows of two blocks of sets to the pairs across components that are similar enough."""
    def counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """Sizes of all intersections: a matrix product over the shingles of both sides."""
        ra, rb = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
        va, vb = np.concatenate(a), np.concatenate(b)
        shared = np.intersect1d(va, vb)
        ka, kb = np.isin(va, shared), np.isin(vb, shared)
        ra, ca = ra[ka], np.searchsorted(shared, va[ka])
        rb, cb = rb[kb], np.searchsorted(shared, vb[kb])
        total = np.zeros(len(a) * len(b))
        oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
        ra, ca, rb, cb = ra[oa], ca[oa], rb[ob], cb[ob]
        many_a, many_b = np.bincount(ca, minlength=len(shared)), np.bincount(cb, minlength=len(shared))
        first_b = np.cumsum(many_b) - many_b
        # A shingle of few sets is counted pair by pair, one of many by the matrix product.
        dense = many_a * many_b > DENSE * len(total)
        light = np.flatnonzero(~dense[ca])
        each = many_b[ca[light]]
        at = np.concatenate([[0], np.cumsum(each)])
        while len(light):
            k = max(1, int(np.searchsorted(at, at[0] + PAIRS, side="right")) - 1)
            rows, reps = light[:k], each[:k]
            own = np.repeat(first_b[ca[rows]] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
            total += np.bincount(np.repeat(ra[rows], reps) * len(b) + rb[own], minlength=len(total))
            light, each, at = light[k:], each[k:], at[k:]
        total = total.reshape(len(a), len(b))
        code = np.cumsum(dense) - 1
        wide = int(dense.sum())
        ka, kb = dense[ca], dense[cb]
        ra, ca, rb, cb = ra[ka], code[ca[ka]], rb[kb], code[cb[kb]]
        for low in range(0, wide, COLUMNS):
            x, y = (np.zeros((len(n), min(COLUMNS, wide - low)), np.float32) for n in (a, b))
            for m, r, c in ((x, ra, ca), (y, rb, cb)):
                i, j = np.searchsorted(c, [low, low + COLUMNS])
                m[r[i:j], c[i:j] - low] = 1
            total += x @ y.T
        return total

    def unpack(block) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        items = block.values
        cuts = items.field("set").offsets.to_numpy()
        body = items.field("set").values.to_numpy()
        return (items.field("rep").to_numpy(), items.field("c").to_numpy(), [body[i:j] for i, j in zip(cuts[:-1], cuts[1:])])

    def run(batches):
        for batch in batches:
            for minor, other in zip(batch.column(0), batch.column(1)):
                ra, ca, sa = unpack(minor)
                rb, cb, sb = unpack(other)
                both = counts(sa, sb)
                na, nb = np.array([len(s) for s in sa]), np.array([len(s) for s in sb])
                i, j = np.nonzero((100 * both >= percent * (na[:, None] + nb[None, :] - both)) & (ca[:, None] != cb[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ra[i], rb[j])), pa.array(np.minimum(ra[i], rb[j]))], names=["a", "b"])

    return run


def _across(members: DataFrame, pivots: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """All links between components of documents that meet in large buckets.

    Documents whose large buckets hang together are a group. What lies outside the group's
    largest component is compared with all of it: both sides are packed into blocks of bounded
    size, and a pair of blocks is answered by a matrix product that gives exact intersection
    sizes. Only similar pairs leave it."""
    groups = components(members.join(pivots, "key").select(F.greatest("rep", "p").alias("a"), F.least("rep", "p").alias("b")))
    placed = components(links)
    held = cut(
        groups.toDF("rep", "g").join(placed.toDF("rep", "c"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
        .join(sets.select(F.col("doc_id").alias("rep"), F.size("set").alias("n")), "rep")
    )
    parts = held.groupBy("g", "c").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    opened = parts.groupBy("g").agg(
        F.max(F.struct("m", "c")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("m").alias("m"),
    ).where("parts > 1").select("g", F.col("top.c").alias("top"), F.ceil(F.greatest(
        F.col("n") / BLOCK_SHINGLES, F.col("m") / BLOCK_SETS)).cast("int").alias("blocks"))
    rows = cut(
        held.drop("n").join(opened, "g").join(sets.withColumnRenamed("doc_id", "rep"), "rep")
        .select("g", "c", "top", "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), "rep", "set")
    )
    item = F.struct("rep", "c", "set")
    whole = rows.groupBy("g", "block").agg(F.collect_list(item).alias("other"))
    minor = (
        rows.where("c <> top").groupBy("g", F.col("block").alias("mine"), "blocks").agg(F.collect_list(item).alias("minor"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
    )
    # Blocks are large rows with much to do, so each has a task of its own if it can.
    tasks = int(min(5000, max(1, opened.agg(F.sum("blocks")).first()[0] or 1)))
    return (
        minor.repartition(tasks, "g", "block").join(whole.repartition(tasks, "g", "block"), ["g", "block"])
        .select("minor", "other")
        .mapInArrow(_matches(percent), T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    )


def _of_one_id(base: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows of one id, which are one document."""
    several = (
        base.where("n > 0 and doc_id is not null").groupBy("doc_id")
        .agg(F.min(F.struct("n", "h1", "h2")).alias("low"), F.max(F.struct("n", "h1", "h2")).alias("high"))
        .where("low <> high").select("doc_id")
    )
    kinds = ["n", "h1", "h2"]
    own = base.join(several, "doc_id", "left_semi").join(classes.select(*kinds, "rep"), kinds).select("doc_id", "rep").distinct()
    return own.where(F.col("rep") != F.col("doc_id")).select(
        F.col("doc_id").cast("long").alias("a"), F.col("rep").cast("long").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs (doc_id, text)``.

    Documents are linked when ``100 * |A and B| >= percent * |A or B|`` for their sets of
    ``words``-word shingles, and a component is called by its smallest id."""
    base = cut(
        docs.select("doc_id", _digest_udf(words)(F.col("text")).alias("d"))
        .select("doc_id", "d.n", "d.h1", "d.h2", "d.sig")
    )
    classes = cut(
        base.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2", "sig")
        .agg(F.min("doc_id").alias("rep"))
    )
    keyed = classes.select("rep", "n", F.explode(_keys("sig")).alias("key"))
    buckets = cut(
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("low"), F.max("rep").alias("high"))
        .where("size > 1")
    )
    members = cut(keyed.join(buckets.where("size > 2").select("key", "size"), "key"))
    popular = members.groupBy("rep").agg(F.sum("size").alias("pop"))
    large = members.where(F.col("size") > SMALL_BUCKET)
    pivots = large.join(popular, "rep").groupBy("key").agg(F.max_by("rep", "pop").alias("p"))
    small = members.where(F.col("size") <= SMALL_BUCKET)
    pairs = (
        buckets.where("size = 2").select(F.col("high").alias("a"), F.col("low").alias("b"))
        .unionByName(
            small.select("key", F.col("rep").alias("a"), F.col("n").alias("na"))
            .join(small.select("key", F.col("rep").alias("b"), F.col("n").alias("nb")), "key")
            .where((F.col("a") > F.col("b")) & _comparable("na", "nb", percent)).select("a", "b"))
        .unionByName(
            large.join(pivots, "key").select(F.greatest("rep", "p").alias("a"), F.least("rep", "p").alias("b")))
        .where("a <> b").distinct()
    )
    near = cut(_near_enough(pairs, classes, percent))
    asked, n_asked = cut_counted(
        near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id")))
        .unionByName(large.select(F.col("rep").alias("doc_id"))).distinct()
    )
    # Few ids go to the texts, so that texts without a partner need not move.
    asked = F.broadcast(asked) if n_asked <= BROADCAST_IDS else asked
    sets = cut(
        docs.select("doc_id", "text").join(asked, "doc_id").distinct()
        .select("doc_id", _sets_udf(words)(F.col("text")).alias("set"))
    )
    # First the nearest partner of each; a pair that this already joins needs no check.
    either = near.select("a", "b", "d", F.col("a").alias("x")).unionByName(near.select("a", "b", "d", F.col("b").alias("x")))
    best = (
        either.groupBy("x").agg(F.min(F.struct("d", "a", "b")).alias("s"))
        .select("s.a", "s.b").distinct()
    )
    links = cut(_confirmed(best, sets, percent))
    rest = _apart(near.join(best, ["a", "b"], "left_anti"), components(links))
    links = cut(links.unionByName(_confirmed(rest, sets, percent)))
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).unionByName(
        _of_one_id(base, classes))
    links = cut(links.unionByName(_across(large.select("key", "rep"), pivots, sets, links, percent).distinct()))
    forget(buckets, members, near, sets)
    named = (
        classes.drop("sig").join(components(links).toDF("rep", "c"), "rep")
        .select("n", "h1", "h2", F.col("c").alias("component"))
    )
    # Of a class, all rows have its component; one without links is called by its smallest id.
    alone = classes.select("n", "h1", "h2", "rep")
    names = alone.join(named, ["n", "h1", "h2"], "left").select(
        "n", "h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = base.join(names, ["n", "h1", "h2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
