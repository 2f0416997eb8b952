"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

Entries become integers, so the scatter n * sum(x x') - S S' is an integer matrix, n^2 times the covariance. Its characteristic
polynomial is found modulo many primes, by reduction to Hessenberg form, and put together by Chinese remaindering. Its roots
are real: sign changes of the shifted polynomial count them exactly with their multiplicities, which isolates them; bisection in
integers makes them as accurate as wanted. A component is the null space of the scatter less its root, by inverse iteration in
fixed-point integers, so near roots cost no digits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.llm.shared import keep, small_batches

#: Entries are counted in steps of 1 / SCALE, from OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Bits of a root beyond its units, relative to the largest root.
ROOT_BITS = 140
#: Bits of the fractions in the inverse iteration.
FIXED = 256
_LIMB = 30
_LONG = 1 << 63


def _whole_numbers(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, entries): which vectors are not null and hold only finite entries, and all their entries as doubles, in turn."""
    lengths = np.array(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = vectors.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    owner = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.bincount(owner[~np.isfinite(values)], minlength=len(lengths)) > 0
    return (lengths > 0) & ~bad, values


def centred_integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) of every entry, so x less OFFSET; entries out of range count as the end of the range."""
    return np.clip(np.floor(SCALE * values), -float(1 << 62), float(1 << 62)).astype(np.int64)


def _exact_products(x: np.ndarray) -> list[list[int]]:
    """x' x in exact integers: by floating point where every sum is below 2^53, else by Python's integers."""
    top = int(np.abs(x).max()) if x.size else 0
    if top * top * max(1, len(x)) < 1 << 53:
        y = x.astype(float)
        return (y.T @ y).astype(np.int64).tolist()
    y = x.astype(object)
    return y.T.dot(y).tolist()


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, place = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield place, sign * (value & ((1 << _LIMB) - 1))
        value >>= _LIMB
        place += 1


@dataclass
class Scatter:
    """n vectors of one length; total[i] sums entries, products[i][j] products of entries, both less OFFSET, exact."""

    n: int
    total: list[int]
    products: list[list[int]]

    def matrix(self) -> list[list[int]]:
        """n^2 times the covariance, exact; what is taken off all entries makes no difference."""
        d = range(len(self.total))
        return [[self.n * self.products[i][j] - self.total[i] * self.total[j] for j in d] for i in d]


def scatter(vectors: DataFrame, column: str) -> Scatter | None:
    """Exact sums over all vectors that count. Each task sends one set of sums per length of vectors, cut into digits that Spark adds
    up; to the driver come the sums of the commonest length (the longest of equally common ones), their number set by it."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            fine, values = _whole_numbers(batch.column(0))
            lengths = np.array(batch.column(0).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            starts = np.append(0, np.cumsum(lengths))
            for d in np.unique(lengths[fine]).tolist():
                rows = starts[:-1][fine & (lengths == d)]
                x = centred_integers(values[rows[:, None] + np.arange(d)])
                own = found.setdefault(d, [0, [0] * d, [[0] * d for _ in range(d)]])
                own[0] += len(x)
                column_sums = x.astype(object).sum(0) if x.size and int(np.abs(x).max()) * len(x) >= _LONG else x.sum(0)
                own[1] = [a + int(b) for a, b in zip(own[1], column_sums, strict=True)]
                own[2] = [[a + b for a, b in zip(p, q, strict=True)] for p, q in zip(own[2], _exact_products(x), strict=True)]
        out: list[tuple[int, int, int, int]] = []
        for d, (n, total, products) in found.items():
            cells = [n, *total, *(products[i][j] for i in range(d) for j in range(i, d))]
            out += [(d, cell, place, digits) for cell, value in enumerate(cells) for place, digits in _limbs(value)]
        for at in range(0, len(out), 50_000):
            parts = list(zip(*out[at : at + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()) for p in parts], ["d", "cell", "place", "digits"])

    digits = small_batches(vectors).select(F.col(column).cast("array<double>").alias("v")).mapInArrow(sums, "d long, cell long, place long, digits long")
    digits = keep(digits.groupBy("d", "cell", "place").agg(F.sum("digits").alias("digits")), "scatter")
    counts = digits.filter("cell = 0").groupBy("d").agg(F.sum(F.col("digits") * F.pow(F.lit(2.0), F.col("place") * _LIMB)).alias("n"))
    best = counts.orderBy(F.col("n").desc(), F.col("d").desc()).limit(1).collect()
    if not best:
        return None
    d = best[0]["d"]
    cells = [0] * (1 + d + d * (d + 1) // 2)
    for row in digits.filter(F.col("d") == d).select("cell", "place", "digits").collect():
        cells[row.cell] += row.digits << (_LIMB * row.place)
    products = [[0] * d for _ in range(d)]
    upper = iter(cells[1 + d :])
    for i in range(d):
        for j in range(i, d):
            products[i][j] = products[j][i] = next(upper)
    return Scatter(cells[0], cells[1 : 1 + d], products)


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` greatest primes below ``top``, by trial division in blocks."""
    small = np.arange(3, isqrt(top) + 1, 2)
    small = small[[all(p % q for q in range(3, isqrt(p) + 1, 2)) for p in small.tolist()]]
    found: list[int] = []
    high = top
    while len(found) < count:
        block = np.arange(high - 1 - (high % 2), max(3, high - 4000), -2)
        alive = np.ones(len(block), bool)
        for p in small.tolist():
            alive &= block % p != 0
        found += block[alive].tolist()
        high = int(block[-1])
    return found[:count]


def characteristic_residues(matrix: Sequence[Sequence[int]], primes: Sequence[int]) -> np.ndarray:
    """Coefficients of det(z - A), constant first, modulo each prime: Hessenberg form by similar row and column steps, then the
    recurrence over its leading blocks. All primes are worked on side by side; they have 31 bits, so products fit."""
    p = np.array(primes, np.int64)
    d = len(matrix)
    a = np.array([[[v % q for v in row] for row in matrix] for q in primes], np.int64)
    each = np.arange(len(p))

    def inverse(v: np.ndarray) -> np.ndarray:
        return np.array([pow(int(x), -1, int(q)) if x else 0 for x, q in zip(v, p, strict=True)], np.int64)

    for k in range(d - 2):
        # a row with something below the diagonal comes up, its column alike
        pivot = k + 1 + (a[:, k + 1 :, k] != 0).argmax(1)
        swap = pivot != k + 1
        if swap.any():
            s, r = each[swap], pivot[swap]
            a[s, k + 1], a[s, r] = a[s, r].copy(), a[s, k + 1].copy()
            a[s, :, k + 1], a[s, :, r] = a[s, :, r].copy(), a[s, :, k + 1].copy()
        factor = a[:, k + 2 :, k] * inverse(a[:, k + 1, k])[:, None] % p[:, None]
        a[:, k + 2 :] = (a[:, k + 2 :] - factor[:, :, None] * a[:, None, k + 1] % p[:, None, None]) % p[:, None, None]
        added = np.zeros((len(p), d), np.int64)
        for j in range(factor.shape[1]):
            added += a[:, :, k + 2 + j] * factor[:, None, j] % p[:, None]
        a[:, :, k + 1] = (a[:, :, k + 1] + added) % p[:, None]
    blocks = [np.zeros((len(p), d + 1), np.int64)]
    blocks[0][:, 0] = 1 % p
    for k in range(d):
        up = np.zeros_like(blocks[k])
        up[:, 1:] = blocks[k][:, :-1]
        up = (up - a[:, k, k][:, None] * blocks[k] % p[:, None]) % p[:, None]
        below = np.ones(len(p), np.int64)
        for i in range(k - 1, -1, -1):
            below = below * a[:, i + 1, i] % p
            up = (up - (below * a[:, i, k] % p)[:, None] * blocks[i] % p[:, None]) % p[:, None]
        blocks.append(up)
    return blocks[d]


def characteristic_polynomial(spark: SparkSession, matrix: Sequence[Sequence[int]]) -> list[int]:
    """Coefficients of det(z - A) of a symmetric matrix without negative roots, constant first, exact. The primes are dealt to tasks;
    a coefficient is at most what equal roots would give, which says how many primes are enough."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    bound = max(comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))
    primes = primes_below(1 << 31, (2 * bound).bit_length() // 30 + 2)
    block = 8

    def residues(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("p").to_pylist()
            for at in range(0, len(own), block):
                some = own[at : at + block]
                found = characteristic_residues(matrix, some)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found.tolist(), pa.list_(pa.int64()))], ["p", "c"])

    pieces = max(1, min(len(primes) // block, spark.sparkContext.defaultParallelism))
    dealt = spark.createDataFrame([(q,) for q in primes], "p long").repartition(pieces, "p")
    rows = sorted(small_batches(dealt).mapInArrow(residues, "p long, c array<long>").collect())
    modulus = 1
    for q, _ in rows:
        modulus *= q
    coefficients = [0] * (d + 1)
    for q, found in rows:
        rest = modulus // q
        part = rest * pow(rest, -1, q)
        coefficients = [c + part * r for c, r in zip(coefficients, found, strict=True)]
    coefficients = [c % modulus for c in coefficients]
    return [c - modulus if c > modulus // 2 else c for c in coefficients]


def _roots_above(coefficients: Sequence[int], at: int) -> int:
    """Roots greater than ``at``, with multiplicity: sign changes of p(z + at), exact as all roots are real."""
    c = list(coefficients)
    for k in range(len(c) - 1):
        for j in range(len(c) - 2, k - 1, -1):
            c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(coefficients: Sequence[int], at: int) -> int:
    found = 0
    for c in reversed(coefficients):
        found = found * at + c
    return found


def largest_roots(coefficients: Sequence[int], count: int, bits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """(root times 2^shift rounded down, shift), greatest first, repeated by multiplicity; only roots above 0, ``count`` at most.

    Roots are isolated by counting; a lone root is then bisected by signs, several that stay together by counting to the end.
    """
    d = len(coefficients) - 1
    top = 1 << max(1, (-coefficients[d - 1]).bit_length())  # above the sum of all roots
    shift = max(0, bits - top.bit_length())
    scaled = [c << (shift * (d - k)) for k, c in enumerate(coefficients)]
    wanted = min(count, _roots_above(scaled, 0))
    found: list[int] = []
    waiting = [(0, top << shift, _roots_above(scaled, 0), 0)]  # (low, high], roots above low, roots above high
    while waiting and len(found) < wanted:
        low, high, above_low, above_high = waiting.pop()
        if above_low == above_high:
            continue
        if high - low == 1:
            found += [low if _value(scaled, high) else high] * (above_low - above_high)
            continue
        if above_low - above_high == 1:
            sign = _value(scaled, high)
            if not sign:
                found.append(high)
                continue
            while high - low > 1:
                middle = (low + high) // 2
                value = _value(scaled, middle)
                if not value:
                    low = middle
                    break
                if (value > 0) == (sign > 0):
                    high = middle
                else:
                    low = middle
            found.append(low)
            continue
        middle = (low + high) // 2
        above = _roots_above(scaled, middle)
        waiting += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return [(r, shift) for r in found[:wanted]]


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solves a x = b in fixed-point integers by elimination with pivots."""
    a, b = a.copy(), b.copy()
    d = len(b)
    for k in range(d):
        pivot = k + int(np.argmax(np.abs(a[k:, k])))
        if pivot != k:
            a[[k, pivot]], b[[k, pivot]] = a[[pivot, k]], b[[pivot, k]]
        if not a[k, k]:
            a[k, k] = 1  # the smallest step stands for an exact zero
        for i in range(k + 1, d):
            if a[i, k]:
                factor = (a[i, k] << FIXED) // a[k, k]
                a[i, k:] = a[i, k:] - ((factor * a[k, k:]) >> FIXED)
                b[i] = b[i] - ((factor * b[k]) >> FIXED)
    x = np.zeros(d, object)
    for k in range(d - 1, -1, -1):
        rest = b[k] - (int((a[k, k + 1 :] * x[k + 1 :]).sum()) >> FIXED if k + 1 < d else 0)
        x[k] = (rest << FIXED) // a[k, k]
    return x


def _unit(x: np.ndarray, others: Sequence[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        top = max(1, int(max(abs(v) for v in x)))
        x = np.array([(v << FIXED) // top for v in x], object)
        for o in others:
            x = x - ((int((x * o).sum() >> FIXED) * o) >> FIXED)
        length = max(1, isqrt(int((x * x).sum())))
        x = np.array([(v << FIXED) // length for v in x], object)
    return x


def components(matrix: Sequence[Sequence[int]], roots: Sequence[tuple[int, int]], seed: int = 11) -> np.ndarray:
    """Unit vectors of the null spaces, a row per root: inverse iteration, orthogonal to those of the same and of nearer roots. The
    largest entry is positive."""
    d = len(matrix)
    size = max(1, sum(matrix[i][i] for i in range(d)))
    scaled = np.array([[(v << FIXED) // size for v in row] for row in matrix], object)
    random = np.random.default_rng(seed)
    found: list[np.ndarray] = []
    for root, shift in roots:
        a = scaled.copy()
        at = (root << FIXED) // (size << shift)
        for i in range(d):
            a[i, i] -= at
        x = _unit(np.array([int(v * (1 << 40)) for v in random.standard_normal(d)], object), found)
        for _ in range(3):
            x = _unit(_solve(a, x), found)
        found.append(x)
    rows = np.array([[float(v / (1 << FIXED)) for v in x] for x in found]).reshape(-1, d)
    for row in rows:
        if row[np.argmax(np.abs(row))] < 0:
            row *= -1
    return rows


@dataclass
class Whitening:
    """n and exact sums of the fit, its components as rows, their eigenvalues and shares of the variance."""

    n: int
    total: list[int]
    axes: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def learn_whitening(vectors: DataFrame, column: str = "embedding", most: int = 8) -> Whitening | None:
    """Components of all vectors that are not null and hold only finite entries, by falling eigenvalue, ``most`` at most.

    Vectors of another length than the commonest are left out, as no covariance is defined for them. Directions without variance
    (repeated rows, one row, fewer rows than entries) are no components. None where no vector is left.
    """
    sums = scatter(vectors, column)
    if sums is None:
        return None
    matrix, d = sums.matrix(), len(sums.total)
    trace = sum(matrix[i][i] for i in range(d))
    if not trace:
        return Whitening(sums.n, sums.total, np.zeros((0, d)), np.zeros(0), np.zeros(0))
    roots = largest_roots(characteristic_polynomial(vectors.sparkSession, matrix), most)
    values = [root / (sums.n * sums.n << shift) for root, shift in roots]
    shares = [root / (trace << shift) for root, shift in roots]
    return Whitening(sums.n, sums.total, components(matrix, roots), np.array(values), np.array(shares))


def _deviations(x: np.ndarray, n: int, total: Sequence[int]) -> list[int]:
    """Sums of (n x - S)^2 over a vector's entries, exact."""
    top = int(np.abs(x).max()) if x.size else 0
    most = n * top + max(map(abs, total), default=0)
    if most * most * max(1, x.shape[1]) < _LONG:
        y = n * x - np.array(total, np.int64)
        return (y * y).sum(1).tolist()
    y = n * x.astype(object) - np.array(total, object)
    return (y * y).sum(1).tolist()


def whiten(vectors: DataFrame, model: Whitening | None, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, deviation, whitened): a row per vector that the fit counts. ``whitened`` holds one value per component; ``deviation`` is
    the exact sum of (n x - S)^2 as decimal digits, as it may be beyond a long.

    Rows with a NULL vector, with null or non-finite entries or with another length are left out; rows with a NULL or repeated id are
    rows of their own; entries beyond 2^62 / SCALE count as that. Only the id and the vector are read. One pass, no shuffle.
    """
    kind = vectors.schema[id_column].dataType.simpleString()
    rows = small_batches(vectors).select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v"))
    schema = f"id {kind}, deviation string, whitened array<double>"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_column)
    mean = np.array([t / model.n for t in model.total])
    turn = (model.axes / np.sqrt(model.eigenvalues)[:, None]).T

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(mean)
        for batch in batches:
            fine, values = _whole_numbers(batch.column("v"))
            lengths = np.array(batch.column("v").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            fine &= lengths == d
            starts = np.append(0, np.cumsum(lengths))[:-1][fine]
            x = centred_integers(values[starts[:, None] + np.arange(d)])
            ids = batch.column("id").filter(pa.array(fine))
            found = (x - mean) @ turn
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([str(v) for v in _deviations(x, model.n, model.total)], pa.string()), pa.array(found.tolist(), pa.list_(pa.float64()))],
                ["id", "deviation", "whitened"],
            )

    return rows.mapInArrow(project, schema).withColumnRenamed("id", id_column)


def identity_error(whitened: DataFrame, width: int, column: str = "whitened") -> float:
    """The largest absolute entry of the covariance less the identity; 0 without components. Covariances are taken about running
    means, in one aggregation."""
    entries = [F.get(column, F.lit(k)) for k in range(width)]
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    if not pairs:
        return 0.0
    errors = [F.abs(F.covar_pop(entries[i], entries[j]) - F.lit(1.0 if i == j else 0.0)) for i, j in pairs]
    found = whitened.agg(*[e.alias(f"e{k}") for k, e in enumerate(errors)]).collect()[0]
    return max((v for v in found if v is not None), default=0.0)
