"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance V of d dimensions is never formed. A block of m vectors goes through passes
``V Q = sum of c (cᵀ Q) / n`` over the centred rows c, each a Spark job whose tasks hand on one
d x m matrix, added in a few lanes after the shuffle. A Chebyshev polynomial of V, applied by its three-term
recurrence, damps the unwanted part of the spectrum; QR and Rayleigh-Ritz follow on the driver,
on d x m numbers. This is repeated until the residuals ``|V q - e q|`` of the wanted pairs
are at the level of rounding. Where the spectrum is so flat that the filter hardly helps, the
block grows; at m = d one pass is exact. A first run of the Lanczos recurrence, which rides along
as one more column, tells how far down the unwanted spectrum reaches.

Entries are counted in whole steps, ``floor(steps * entry) + SHIFT``, so sums over the fit list
are exact, and centring takes place in whole numbers before anything is multiplied.

Defined results. Rows whose vector is null or has a null or non-finite entry are left out.
Shorter vectors count as padded with zeros up to the longest; an empty one is all zeros.
Equal vectors are one in the fit list, however many rows have them, and each row gets
its own result. Components whose variance is zero up to rounding (constant dimensions, fewer
vectors than dimensions) cannot be whitened and are left out; an empty table, or a single distinct
vector, has no components. Scaled entries beyond ±9.2e18 count as that. Null ids are values like
others and further columns are carried through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as t
from pyspark.sql.functions import arrow_udf

from ..plans.checkpoints import cut, forget

# Fixed values of the counted entries.
STEPS, SHIFT = 64, 1_000_000
FARTHEST = 9_200_000_000_000_000_000
COMPONENTS = 16
#: Vectors of the block beyond the wanted ones.
GUARD = 16
#: Residuals, relative to the largest eigenvalue, at which a pair is certified. Below LOOSE a
#: round that does not halve them has met the rounding of the sums.
TIGHT, LOOSE = 1e-14, 1e-11
MOST_DEGREE, LANCZOS_STEPS = 24, 8
#: Numbers of one block of rows inside a task.
BLOCK_NUMBERS = 1 << 19
#: Eigenvalues below this share of the trace are zero up to rounding.
ZERO_SHARE = 1e-12
#: Partial sums of one pass that reach the driver, at most.
LANES = 16
_SAFE = 1 << 62


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def counted(vector: Column, width: int) -> Column:
    """Whole steps of every entry (without SHIFT, which no centred number knows), padded."""
    far = float(FARTHEST)
    steps = F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * STEPS, F.lit(-far)), F.lit(far))))
    return F.concat(steps, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), F.lit(width) - F.size(steps))))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` entries; shorter lists are padded with zeros, longer ones cut."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), flat.dtype)
    row = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    fits = place < width
    out[row[fits], place[fits]] = flat[fits]
    return out


def _blocks(lists: pa.Array, width: int):
    """Row blocks of bounded size."""
    step = max(1, BLOCK_NUMBERS // max(width, 1))
    for a in range(0, len(lists), step):
        yield matrix(lists.slice(a, step), width)


@dataclass(frozen=True)
class Fit:
    """``n`` distinct vectors with sums ``sums`` of whole steps; unit ``vectors`` by column with
    their ``values``, falling; the trace and the error of the identity that was measured."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int = 0

    @property
    def width(self) -> int:
        return len(self.sums)

    def apart(self, x: np.ndarray) -> np.ndarray:
        """``n x - S``, in 64-bit whole numbers where they are safe and in Python's otherwise."""
        top = max(int(np.abs(x).max(initial=0)), 1)
        if x.dtype == np.int64 and top < _SAFE // (2 * max(self.n, 1)) and self.sums.dtype == np.int64:
            return x * self.n - self.sums
        return x.astype(object) * self.n - self.sums.astype(object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.apart(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums of ``(n x - S)²``."""
        far = self.apart(x)
        top = max((abs(int(v)) for v in (far.max(initial=0), far.min(initial=0))), default=0)
        if far.dtype == np.int64 and top * top * max(self.width, 1) < _SAFE:
            return (far * far).sum(axis=1).tolist()
        far = far.astype(object)
        return [int((row * row).sum()) for row in far]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))


def _sums(fit_list: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums by dimension."""
    if width == 0:
        return fit_list.count(), np.zeros(0, np.int64)

    def add(batches):
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            for x in _blocks(batch.column(0), width):
                n += len(x)
                safe = int(np.abs(x).max(initial=0)) * len(x) < _SAFE
                total = total + (x.sum(axis=0) if safe else x.astype(object).sum(axis=0)).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width, dtype=np.int32)), pa.array([n] * width, pa.int64()),
                 pa.array([int(v) for v in total], pa.decimal128(38, 0))], names=["i", "n", "s"])

    got = fit_list.mapInArrow(add, "i int, n long, s decimal(38,0)").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    if not got:
        return 0, np.zeros(width, np.int64)
    sums = [int(r["s"]) for r in sorted(got, key=lambda r: r["i"])]
    return got[0]["n"], np.array(sums, np.int64 if max(map(abs, sums)) < _SAFE else object)


def _summed(fit_list: DataFrame, rows: int, columns: int, part) -> np.ndarray:
    """Sum of the ``rows x columns`` matrices that ``part`` makes of all blocks of the fit list.
    Each task hands on one matrix as one row; these are added in lanes, which are few."""

    def run(batches):
        total = None
        for batch in batches:
            made = part(batch.column(0))
            if made is not None:
                total = made if total is None else total + made
        if total is not None:
            yield packed(TaskContext.get().partitionId() % LANES, total)

    def add(batches):
        total = np.zeros((rows, columns))
        for batch in batches:
            for made in batch.column(1):
                total += np.frombuffer(made.as_buffer(), np.float64).reshape(rows, columns)
        yield packed(0, total)

    def packed(lane: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["lane", "part"])

    schema = "lane int, part binary"
    got = fit_list.mapInArrow(run, schema).repartition("lane").mapInArrow(add, schema).toArrow()
    return sum((np.frombuffer(made.as_buffer(), np.float64) for made in got.column("part")),
               start=np.zeros(rows * columns)).reshape(rows, columns)


class Operator:
    """The covariance as something that multiplies blocks of vectors."""

    def __init__(self, fit_list: DataFrame, centre: Fit):
        self.fit_list, self.centre, self.passes = fit_list, centre, 0

    def __call__(self, q: np.ndarray) -> np.ndarray:
        self.passes += 1
        context = self.fit_list.sparkSession.sparkContext
        sent = context.broadcast((self.centre, q))

        def part(lists):
            centre, block = sent.value
            total = None
            for x in _blocks(lists, centre.width):
                c = centre.centred(x)
                made = c.T @ (c @ block)
                total = made if total is None else total + made
            return total

        out = _summed(self.fit_list, q.shape[0], q.shape[1], part) / self.centre.n
        sent.unpersist()
        return out

    def trace(self) -> float:
        centre = self.centre

        def part(lists):
            return sum((np.array([[np.square(centre.centred(x)).sum()]]) for x in _blocks(lists, centre.width)),
                       start=np.zeros((1, 1)))

        return float(_summed(self.fit_list, 1, 1, part)[0, 0]) / centre.n

    def identity_error(self, vectors: np.ndarray, values: np.ndarray) -> float:
        """Largest absolute entry of the covariance of the whitened fit list, minus the identity."""
        k = len(values)
        fit = Fit(self.centre.n, self.centre.sums, vectors, values, 0.0, 0.0)

        def part(lists):
            total = np.zeros((k + 1, k))
            for x in _blocks(lists, fit.width):
                w = fit.whitened(x)
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
            return total

        got = _summed(self.fit_list, k + 1, k, part) / fit.n
        return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max(initial=0.0))


def _lowest(alpha: list[float], beta: list[float]) -> float:
    """A lower end of the spectrum from the Lanczos coefficients: the smallest Ritz value less
    the last coupling, and no less than zero."""
    t3 = np.diag(alpha) + np.diag(beta[:len(alpha) - 1], 1) + np.diag(beta[:len(alpha) - 1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t3)[0]) - beta[len(alpha) - 1])


def _filtered(times, q: np.ndarray, vq: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """Scaled Chebyshev polynomial of the operator on a block: small on [low, high], one at top.
    ``vq`` is the first product, which is known already."""
    centre, half = (low + high) / 2, (high - low) / 2
    sigma = first = half / (top - centre)
    before, now = q, (vq - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (times(now) - centre * now) * (2 * following / half) - before * (sigma * following)
        sigma = following
    return now


def _rayleigh_ritz(q: np.ndarray, vq: np.ndarray):
    """Block and products turned to Ritz vectors, with their values, falling."""
    small = q.T @ vq
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn, values = turn[:, ::-1], values[::-1]
    return q @ turn, vq @ turn, values


def top_eigenpairs(times, width: int, k: int, guard: int = GUARD, seed: int = 11):
    """The ``k`` largest eigenpairs of a positive semidefinite operator ``times`` on blocks:
    (unit vectors by column, values, largest relative residual)."""
    random = np.random.default_rng(seed)
    m = min(width, k + guard)
    q = np.eye(width) if m == width else np.linalg.qr(random.standard_normal((width, m)))[0]
    # The Lanczos vector rides along with the passes of the first rounds.
    v = random.standard_normal(width)
    v, v_before, alpha, beta = v / np.linalg.norm(v), np.zeros(width), [], []

    def ride(block):
        nonlocal v, v_before
        if len(alpha) == LANCZOS_STEPS or (beta and beta[-1] == 0):
            return times(block)
        both = times(np.column_stack([block, v]))
        w = both[:, -1] - (beta[-1] * v_before if beta else 0)
        alpha.append(float(w @ v))
        w = w - alpha[-1] * v
        size = float(np.linalg.norm(w))
        beta.append(size if size > 1e-12 * max(abs(alpha[0]), 1e-300) else 0.0)
        v_before, v = v, (w / size if beta[-1] else np.zeros(width))
        return both[:, :-1]

    whole = lambda: q.shape[1] == width
    q, vq, values = _rayleigh_ritz(q, times(q) if whole() else ride(q))
    last = np.inf
    while True:
        top = max(values[0], 0.0)
        gaps = np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0)
        worst = float(gaps.max(initial=0.0)) / top if top else 0.0
        if whole() or worst <= TIGHT or (worst <= LOOSE and worst > last / 2):
            return q[:, :k], values[:k], worst
        low, high = _lowest(alpha, beta), float(values[-1])
        low = low if low < high else 0.0
        # How much one degree gains for the last wanted pair, and how many are needed.
        reach = (values[k - 1] - (low + high) / 2) / ((high - low) / 2) if high > low else np.inf
        gain = np.arccosh(min(max(reach, 1.0), 1e8))
        wanted = np.log(worst / TIGHT) / gain if gain > 0 else np.inf
        known = len(alpha) == LANCZOS_STEPS or (beta and beta[-1] == 0)
        if known and (wanted > 8 * MOST_DEGREE or worst > last / 2):
            # Too flat, or no gain: a wider block reaches further down the spectrum.
            more = min(width - q.shape[1], q.shape[1])
            q = np.linalg.qr(np.column_stack([q, random.standard_normal((width, more))]))[0]
            q = np.eye(width) if whole() else q
            last = np.inf
        else:
            degree = int(np.clip(np.ceil(wanted), 2, MOST_DEGREE if known else LANCZOS_STEPS))
            if high <= low:
                q = vq  # the rest of the spectrum is zero: a plain power step
            else:
                q = _filtered(ride, q, vq, low, high, top, degree)
            q = np.linalg.qr(q)[0]
            last = worst
        q, vq, values = _rayleigh_ritz(q, ride(q))


def fit(rows: DataFrame, column: str = "embedding", k: int = COMPONENTS, guard: int = GUARD) -> Fit:
    """Means and leading components of the distinct vectors of a column. The fit list is stored
    once; copies are merged before and after the shuffle, so a vector in a third of all rows costs
    one row of each task."""
    vector = F.col(f"`{column}`")
    good = rows.where(usable(vector))
    width = good.agg(F.max(F.size(vector))).first()[0] or 0
    nothing = Fit(0, np.zeros(width, np.int64), np.zeros((width, 0)), np.zeros(0), 0.0, 0.0)
    fit_list = cut(good.select(counted(vector, width).alias("x")).distinct())
    n, sums = _sums(fit_list, width)
    centre = Fit(n, sums, nothing.vectors, nothing.values, 0.0, 0.0)
    if n < 2 or width == 0:
        forget(fit_list)
        return centre
    operator = Operator(fit_list, centre)
    trace = operator.trace()
    if trace == 0:
        forget(fit_list)
        return centre
    vectors, values, _ = top_eigenpairs(operator, width, min(k, width), guard)
    real = values > ZERO_SHARE * trace
    vectors, values = vectors[:, real], values[real]
    error = operator.identity_error(vectors, values)
    forget(fit_list)
    return Fit(n, sums, vectors, values, trace, error, operator.passes)


def whitened(rows: DataFrame, model: Fit, column: str = "embedding") -> DataFrame:
    """Rows with a usable vector, with ``wh_deviation`` decimal(38,0) (null where it has more
    digits) and ``wh_values`` array<double>, one entry per component of the model."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    out = t.StructType([t.StructField("deviation", t.DecimalType(38, 0)), t.StructField("values", t.ArrayType(t.DoubleType()))])

    @arrow_udf(out)
    def project(lists: pa.Array) -> pa.Array:
        held = shared.value
        far, values = [], []
        for x in _blocks(lists, held.width):
            if held.n == 0 or held.width == 0:
                far += [0] * len(x)
                values += [[]] * len(x)
                continue
            far += [d if d < 10 ** 38 else None for d in held.deviations(x)]
            values += list(held.whitened(x))
        return pa.StructArray.from_arrays(
            [pa.array(far, pa.decimal128(38, 0)), pa.array(values, pa.list_(pa.float64()))], ["deviation", "values"])

    found = project.asNondeterministic()(counted(F.col(f"`{column}`"), model.width))
    return (
        rows.where(usable(F.col(f"`{column}`"))).withColumn("__wh", found)
        .withColumn("wh_deviation", F.col("__wh.deviation")).withColumn("wh_values", F.col("__wh.values")).drop("__wh")
    )
