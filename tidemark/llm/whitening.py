"""Embedding whitening by spectrum slicing.

The leading eigenvalues of the covariance are isolated by counting: by Sylvester's law of inertia, as many eigenvalues lie
above a shift as the block-diagonal factor of ``LDLᵀ`` of the shifted matrix has positive ones. Bisection on that count finds an
interval that holds eigenvalue number ``k`` alone, inverse iteration and then Rayleigh quotient iteration converge in it, and two
more counts, just below and above the result, certify its number. Eigenvalues closer than rounding can tell are one cluster, of
which any orthonormal basis serves.

Vectors are made whole numbers, ``floor(1024 c) + 100000``, so that their sums are exact. Tasks sum up what they read, sums by
dimension first, then, centred on the exact means, products by pairs of dimensions, from which ``d (d + 1) / 2`` numbers reach the
driver. A last pass measures the covariance of the whitened columns themselves.

Null vectors and those with null or non-finite entries, or with entries whose whole numbers are beyond ``2**53``, are left out; so are
vectors of another length than the commonest (of the longest such). Ids may be null or repeat. Components whose eigenvalue is not
certain to be above zero are not returned, so with few or equal vectors there are fewer, perhaps none. A ``deviation`` too large for
a long is null. Larger dimensions than ``MAX_DIMENSIONS`` are refused.
"""

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.rows import fields, limit_batches, others

COMPONENTS = 8
SCALE, OFFSET = 1024, 100_000  # fixed: how entries become whole numbers
MAX_DIMENSIONS = 2_048
ROWS = 4_096  # vectors that are computed on at one time
_LARGEST = 2**53
_EPS = np.finfo(float).eps
_PIVOT = (1 + 17 ** 0.5) / 8  # bounds the growth of elements in the factorisation


def factor(matrix: np.ndarray):
    """``P A Pᵀ = L D Lᵀ`` of a symmetric matrix, with pivot blocks of one or two rows chosen from at most two columns:
    ``(order, L, blocks)``, ``blocks`` a list of (first row, block). A pivot column of nothing but zeros stays as it is."""
    a = np.array(matrix, float)
    n = len(a)
    order, blocks, k = np.arange(n), [], 0
    lower = np.eye(n)

    def swap(i, j):
        if i != j:
            a[[i, j], :] = a[[j, i], :]
            a[:, [i, j]] = a[:, [j, i]]
            lower[[i, j], :k] = lower[[j, i], :k]
            order[[i, j]] = order[[j, i]]

    while k < n:
        size, below = 1, np.abs(a[k + 1:, k])
        most = below.max(initial=0)
        if abs(a[k, k]) < _PIVOT * most:
            r = k + 1 + int(below.argmax())
            beside = np.abs(a[k:, r])
            beside[r - k] = 0
            if abs(a[k, k]) * beside.max() < _PIVOT * most ** 2:
                if abs(a[r, r]) >= _PIVOT * beside.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    size = 2
        block = a[k:k + size, k:k + size].copy()
        blocks.append((k, block))
        if k + size < n and np.abs(block).max() > 0:
            column = a[k + size:, k:k + size]
            part = np.linalg.solve(block, column.T).T if size == 2 else column / block[0, 0]
            lower[k + size:, k:k + size] = part
            a[k + size:, k + size:] -= part @ column.T
        k += size
    return order, lower, blocks


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are larger than ``shift``."""
    count = 0
    for _, block in factor(matrix - shift * np.eye(len(matrix)))[2]:
        if len(block) == 1:
            count += block[0, 0] > 0
        else:
            rooted = block[0, 0] * block[1, 1] - block[0, 1] * block[1, 0]
            count += 1 if rooted < 0 else 2 * (block[0, 0] + block[1, 1] > 0)
    return int(count)


def solve(factored, right: np.ndarray, least: float) -> np.ndarray:
    """``x`` of ``A x = right``; a pivot smaller than ``least`` counts as ``least``, as inverse iteration wants it."""
    order, lower, blocks = factored
    x = _substitute(lower, right[order])
    for k, block in blocks:
        if len(block) == 1:
            pivot = block[0, 0]
            x[k] /= pivot if abs(pivot) >= least else least
        else:
            x[k:k + 2] = np.linalg.solve(block, x[k:k + 2])
    x = _substitute(lower.T[::-1, ::-1], x[::-1])[::-1]
    out = np.empty_like(x)
    out[order] = x
    return out


def _substitute(lower, right):
    x = right.copy()
    for i in range(1, len(x)):
        x[i] -= lower[i, :i] @ x[:i]
    return x


@dataclass(frozen=True)
class Spectrum:
    """Eigenvalues, falling, and unit eigenvectors in rows; ``certified``: the counts confirmed each number."""

    values: np.ndarray
    vectors: np.ndarray
    certified: bool


def leading(matrix: np.ndarray, wanted=COMPONENTS) -> Spectrum:
    """The largest eigenvalues that are certain to be above zero, ``wanted`` at most, with their vectors."""
    matrix = (matrix + matrix.T) / 2
    n = len(matrix)
    norm = float(np.abs(matrix).sum(1).max()) if n else 0.0
    close = 8 * n * _EPS * norm  # what rounding may move an eigenvalue by
    known = {norm + close: 0}  # shift: eigenvalues above it

    def count(shift):
        if shift not in known:
            known[shift] = above(matrix, shift)
        return known[shift]

    found, values, certified = np.zeros((0, n)), [], True
    while norm and len(values) < min(wanted, n, count(close)):
        k = len(values)
        low = max(x for x, above_it in known.items() if above_it > k)
        high = min(x for x, above_it in known.items() if above_it <= k)
        # Eigenvalue k (from 0) is above ``low`` and not above ``high``.
        while high - low > close and known[low] - known[high] > 1:
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) > k else (low, middle)
        cluster = known[low] - k  # one, but for eigenvalues that rounding cannot tell apart
        for _ in range(min(cluster, wanted - k)):
            value, vector, low, high = _refined(matrix, k, low, high, found, close, count)
            found = np.vstack([found, vector])
            values.append(value)
            if cluster == 1:
                certified &= count(value - 2 * close) >= k + 1 and count(value + 2 * close) <= k
    order = np.argsort(-np.array(values), kind="stable")
    return Spectrum(np.array(values)[order], found[order], bool(certified))


def _refined(matrix, k, low, high, found, close, count):
    """Value and vector in ``(low, high]`` by Rayleigh quotient iteration; an iteration that leaves the interval begins again
    in its half that holds eigenvalue number ``k``."""
    n = len(matrix)
    start = np.random.default_rng(n).standard_normal(n)

    def cleaned(x):
        for _ in range(2):
            x = x - found.T @ (found @ x)
        return x / np.linalg.norm(x)

    def measured(x):
        value = float(x @ matrix @ x)
        return value, float(np.linalg.norm(matrix @ x - value * x))

    def shifted(x, shift):
        return cleaned(solve(factor(matrix - shift * np.eye(n)), x, close * _EPS))

    while True:
        vector, middle = cleaned(start), (low + high) / 2
        factored = factor(matrix - middle * np.eye(n))
        for _ in range(3):
            vector = cleaned(solve(factored, vector, close))
        value, off = measured(vector)
        for _ in range(12):
            if off <= close or not low - close <= value <= high + close:
                break
            vector = shifted(vector, value)
            value, off = measured(vector)
        if high - low <= close or low - close <= value <= high + close and off <= 4 * close:
            once_more = shifted(vector, value)
            last, rest = measured(once_more)
            return (last, once_more, low, high) if rest < off else (value, vector, low, high)
        low, high = (middle, high) if count(middle) > k else (low, middle)


@dataclass(frozen=True)
class Whitener:
    """What the tasks need: number of vectors, exact sums, means, and the projection, one component a row."""

    n: int
    sums: tuple
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    certified: bool

    @property
    def dimensions(self):
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list:
        """Exact sums of ``(n x - S)²``; None beyond a long."""
        off = x - np.array([s // self.n for s in self.sums], np.int64)
        largest = int(np.abs(off).max(initial=0)) + 1
        if (self.n * largest) ** 2 * max(self.dimensions, 1) < 2**63:
            d = self.n * off - np.array([s % self.n for s in self.sums], np.int64)
            return (d * d).sum(1).tolist()
        rests = [s % self.n for s in self.sums]
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, rests)) for row in off.tolist()]
        return [v if v < 2**63 else None for v in exact]


def _centred(x, n, sums):
    """``x - S / n`` with one rounding: the whole part of the mean is taken off exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole).astype(float) - np.array([(s % n) / n for s in sums])


def whole_numbers(column: pa.Array):
    """(rows whose entries are all usable, their lengths, their whole numbers one after the other)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid, flat = column.is_valid().to_numpy(zero_copy_only=False), column.flatten()
    lengths = np.where(valid, np.diff(column.offsets.to_numpy()), 0) if len(column) else np.zeros(0, np.int64)
    entries = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        made = np.floor(SCALE * entries) + OFFSET
        bad = ~(np.abs(made) < _LARGEST)
    row_of = np.repeat(np.arange(len(lengths)), lengths)
    usable = valid & (np.bincount(row_of[bad], minlength=len(lengths)) == 0)
    return usable, lengths, np.where(bad, 0, made).astype(np.int64)


def _blocks(batches, dimensions, vector):
    """(the rows of a piece of a batch that hold usable vectors of this length, the batch's piece, the vectors)."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            part = batch.slice(begin, ROWS)
            usable, lengths, flat = whole_numbers(part.column(vector))
            kept = usable & (lengths == dimensions)
            starts = (np.cumsum(lengths) - lengths)[kept]
            yield np.flatnonzero(kept), part, flat[starts[:, None] + np.arange(dimensions)]


_LONG_SUM = T.StructType([T.StructField("length", T.IntegerType()), T.StructField("at", T.IntegerType()),
                          T.StructField("n", T.LongType()), T.StructField("total", T.DecimalType(38, 0))])


def sums(vectors: DataFrame) -> list:
    """Rows ``length, at, n, total``: exact sums by length of vector and dimension (``at`` -1: the number of vectors)."""
    schema = pa.schema([("length", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))])

    def run(batches):
        held: dict = {}
        for batch in batches:
            usable, lengths, flat = whole_numbers(batch.column(0))
            starts = np.cumsum(lengths) - lengths
            for length in np.unique(lengths[usable]).tolist():
                if length > MAX_DIMENSIONS:
                    raise ValueError(f"a vector has {length} entries, more than {MAX_DIMENSIONS}")
                own = starts[usable & (lengths == length)]
                x = flat[own[:, None] + np.arange(length)]
                n, total = held.get(length, (0, [0] * length))
                high, low = (x >> 20).sum(0).tolist(), (x & (2**20 - 1)).sum(0).tolist()
                held[length] = n + len(x), [t + (a << 20) + b for t, a, b in zip(total, high, low)]
        for length, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([length] * (length + 1), pa.int32()), pa.array(range(-1, length), pa.int32()),
                pa.array([n] * (length + 1), pa.int64()), pa.array(map(Decimal, [0, *total]), pa.decimal128(38, 0))], schema=schema)

    found = vectors.mapInArrow(run, _LONG_SUM).groupBy("length", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    best = found.where("at = -1").orderBy(F.desc("n"), F.desc("length")).limit(1).collect()
    if not best:
        return []
    return [best[0].n, best[0].length, *found.where((F.col("length") == best[0].length) & (F.col("at") >= 0)).orderBy("at").collect()]


def products(vectors: DataFrame, dimensions: int, size: int, made) -> np.ndarray:
    """Sums over all usable vectors of ``y yᵀ`` and of ``y``, where ``made(x)`` gives ``y`` in ``size`` columns: the sums of ``y`` are
    the last row. Tasks sum up what they read; what is shuffled is one number per task and pair of dimensions."""
    def run(batches):
        total = np.zeros((size + 1, size))
        for _, _, x in _blocks(batches, dimensions, 0):
            y = made(x)
            total[:size] += y.T @ y
            total[size] += y.sum(0)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(size + 2, dtype=np.int32) * size), pa.array(total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), rows], names=["i", "row"])

    rows = vectors.mapInArrow(run, fields(i="int", row="array<double>"))
    cells = rows.select("i", F.posexplode("row").alias("j", "v")).where("i <= j OR i = " + str(size))
    found = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size + 1, size))
    out[found["i"].to_numpy(), found["j"].to_numpy()] = found["v"].to_numpy()
    out[:size] = np.triu(out[:size]) + np.triu(out[:size], 1).T
    return out


def fit(vectors: DataFrame, components=COMPONENTS) -> Whitener | None:
    """The whitener of a column of vectors; None if no vector is usable."""
    limit_batches(vectors.sparkSession)
    found = sums(vectors)
    if not found:
        return None
    n, length, *rows = found
    total = tuple(int(r.total) for r in rows)
    scatter = products(vectors, length, length, lambda x: _centred(x, n, total)) if length else np.zeros((1, 0))
    mean = scatter[-1] / n  # what rounding left of it
    covariance = scatter[:-1] / n - np.outer(mean, mean)
    spectrum = leading(covariance, components)
    return Whitener(n, total, spectrum.values, spectrum.vectors, float(np.trace(covariance)), spectrum.certified)


def identity_error(vectors: DataFrame, model: Whitener) -> float:
    """Largest absolute entry of the covariance of the whitened columns minus the identity, measured over all vectors."""
    size = len(model.values)
    if not size:
        return 0.0
    found = products(vectors, model.dimensions, size, model.whiten)
    mean = found[-1] / model.n
    return float(np.abs(found[:-1] / model.n - np.outer(mean, mean) - np.eye(size)).max())


ADDED = fields(component="int", n="bigint", deviation="bigint", whitened="double", explained="double", identity_error="double",
               certified="boolean")


def whiten(rows: DataFrame, vector="embedding", keep=None, components=COMPONENTS) -> DataFrame:
    """One row for each usable vector and component, with the kept columns and ``component, n, deviation, whitened, explained,
    identity_error, certified``; columns so named are replaced."""
    keep = others(rows.select(*[f"`{c}`" for c in (keep if keep is not None else rows.columns)]), ADDED.names)
    only = rows.select(F.col(f"`{vector}`").cast("array<double>").alias("v"))
    model = fit(only, components)
    given = [f"__c{i}" for i in range(len(keep))]  # names may hold dots
    source = rows.select(*[F.col(f"`{c}`").alias(g) for c, g in zip(keep, given)], F.col(f"`{vector}`").cast("array<double>").alias("__vector"))
    schema = T.StructType([*source.schema.fields[:-1], *ADDED.fields])

    def named(found):
        return found.select(*[F.col(g).alias(c) for c, g in zip(keep, given)], *ADDED.names)

    if model is None or not len(model.values):
        return named(rows.sparkSession.createDataFrame([], schema))
    error, size = identity_error(only, model), len(model.values)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    explained = model.values / model.trace

    def run(batches):
        own = shared.value
        for kept, part, x in _blocks(batches, own.dimensions, len(keep)):
            if len(kept):
                taken = part.take(pa.array(np.repeat(kept, size)))
                every = len(kept)
                yield pa.RecordBatch.from_arrays([
                    *taken.columns[:len(keep)], pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), every)),
                    pa.array(np.full(every * size, own.n)), pa.array([d for d in own.deviations(x) for _ in range(size)], pa.int64()),
                    pa.array(own.whiten(x).ravel()), pa.array(np.tile(explained, every)), pa.array(np.full(every * size, error)),
                    pa.array(np.full(every * size, own.certified))], names=schema.names)

    return named(source.mapInArrow(run, schema))
