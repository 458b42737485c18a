"""Embedding whitening from the exact characteristic polynomial of the integer scatter.

Every entry becomes an integer, so sums and products over all rows are exact however Spark
splits them.  From there on

1. ``scatter``: one pass; each task adds up its rows, Spark adds up the tasks.  What is
   gathered is a matrix, whose size depends on the dimension and not on the rows.
2. ``characteristic_polynomial``: the integer matrix modulo many primes is brought to Hessenberg
   form, one Spark task a few primes, and the coefficients are put together by the Chinese
   remainder theorem.  Maclaurin's bound on the coefficients says how many primes it takes.
3. ``components``: all roots are real, so by Descartes' rule the sign changes of the polynomial
   moved to ``a`` are exactly the roots above ``a``; bisection with integers isolates each
   eigenvalue to ``ROOT_BITS`` bits.  Inverse iteration with ``DIGITS`` digits finds the null
   space of the matrix less its eigenvalue, one Spark task a component.
4. ``whiten``: a second pass projects the centred rows; the covariance of what it wrote is
   measured by Spark.

Defined cases: rows whose vector is null, or holds a null, NaN or infinite entry, are left out.  So
are rows whose vector is not as long as most (of equally frequent lengths: the longest); vectors
without entries are left out too.  Entries are clipped to 62 bits.  Eigenvalues that agree in
``ROOT_BITS`` bits share one null space, whose basis is the same for all rows.  A component
of no variance cannot be whitened and is not given, so one row, or equal rows, give no rows.
Ids may be null or repeated.  Only the columns in ``keep`` are carried; a result of the same name
replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

#: An entry c becomes floor(SCALE * c) + ORIGIN.  ORIGIN moves all rows alike: no result depends on it.
SCALE, ORIGIN = 1024, 100_000
COMPONENTS = 8
#: Relative width, in bits, to which an eigenvalue is isolated; digits of the inverse iteration.
ROOT_BITS, DIGITS, ITERATIONS = 120, 100, 4
#: Sums of products of two limbs over a block of rows stay below 2**53, where doubles are exact.
LIMB_BITS, BLOCK_ROWS = 20, 4096
#: Sums travel in limbs, so that Spark adds longs without overflow.
SUM_BITS = 30
LARGEST = 2.0**62


@dataclass(frozen=True)
class Scatter:
    """Rows, sums and sums of products of the integer vectors."""

    n: int
    sums: list[int]
    products: list[list[int]]

    def centred(self) -> list[list[int]]:
        """n * products - sums * sums: n**2 times the covariance, in integers."""
        d = range(len(self.sums))
        return [[self.n * self.products[i][j] - self.sums[i] * self.sums[j] for j in d] for i in d]


def _integers(lists: pa.Array, d: int) -> np.ndarray:
    """floor(SCALE * c) of lists of ``d`` entries each; ORIGIN cancels and is not added."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64).reshape(-1, d)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Doubles of LIMB_BITS bits whose weighted sum is ``x``; the last one has the sign."""
    out = []
    while x.size and max(-int(x.min()), int(x.max())) >> LIMB_BITS:
        out.append((x & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        x = x >> LIMB_BITS
    return [*out, x.astype(np.float64)]


def _block_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact column sums and products of one block, as Python integers."""
    limbs = _limbs(x)
    d = x.shape[1]
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    for i, a in enumerate(limbs):
        sums += a.sum(0).astype(np.int64).astype(object) << (LIMB_BITS * i)
        for j, b in enumerate(limbs):
            products += (a.T @ b).astype(np.int64).astype(object) << (LIMB_BITS * (i + j))
    return sums, products


def _task_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task: (vector length, position in the upper triangle, limb, sum)."""
    totals: dict[int, list] = {}
    for batch in batches:
        lists, sizes = batch.column(0), batch.column(1).to_numpy()
        for d in np.unique(sizes).tolist():
            x = _integers(lists.filter(pa.array(sizes == d)), d)
            own = totals.setdefault(d, [0, np.zeros(d, object), np.zeros((d, d), object)])
            for at in range(0, len(x), BLOCK_ROWS):
                sums, products = _block_sums(x[at : at + BLOCK_ROWS])
                own[0] += len(x[at : at + BLOCK_ROWS])
                own[1] += sums
                own[2] += products
    rows = []
    for d, (n, sums, products) in totals.items():
        for k, value in enumerate([n, *sums, *products[np.triu_indices(d)]]):
            sign, rest, limb = (-1 if value < 0 else 1), abs(int(value)), 0
            while rest or not (k or limb):
                rows.append((d, k, limb, sign * (rest & ((1 << SUM_BITS) - 1))))
                rest >>= SUM_BITS
                limb += 1
    columns = list(zip(*rows)) or [()] * 4
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["d", "k", "limb", "v"])


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows of finite vectors, as ``_x`` with their length ``_d``."""
    finite = F.forall("_x", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return (
        rows.withColumn("_x", F.col(vector).cast("array<double>"))
        .filter(F.col("_x").isNotNull() & finite & (F.size("_x") > 0))
        .withColumn("_d", F.size("_x"))
    )


def scatter(rows: DataFrame, vector: str) -> Scatter | None:
    """Sums over all usable vectors of the most frequent length; none if there are none."""
    parts = usable(rows.select(vector), vector).select("_x", "_d").mapInArrow(_task_sums, "d int, k int, limb int, v long")
    total: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("d", "k", "limb").agg(F.sum("v").alias("v")).toLocalIterator():
        own = total.setdefault(r.d, {})
        own[r.k] = own.get(r.k, 0) + (r.v << (SUM_BITS * r.limb))
    if not total:
        return None
    d = max(total, key=lambda size: (total[size][0], size))
    own = total[d]
    products = [[0] * d for _ in range(d)]
    for k, (i, j) in enumerate(zip(*np.triu_indices(d)), d + 1):
        products[i][j] = products[j][i] = own.get(k, 0)
    return Scatter(own[0], [own.get(1 + k, 0) for k in range(d)], products)


def primes_below(limit: int, product_over: int) -> list[int]:
    """Primes from ``limit`` downwards until their product is over ``product_over``."""
    out, product, p = [], 1, limit - 1 if limit % 2 == 0 else limit - 2
    while product <= product_over:
        if _is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def _is_prime(p: int) -> bool:
    """Miller and Rabin's test; these bases decide for all p below 2**32."""
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, p)
        if x not in (1, p - 1) and not any((x := x * x % p) == p - 1 for _ in range(twos - 1)):
            return False
    return True


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Characteristic polynomial modulo a prime below 2**31, lowest coefficient first."""
    h = matrix.copy()
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        if at := int(below[0]):
            h[[m, m + at]] = h[[m + at, m]]
            h[:, [m, m + at]] = h[:, [m + at, m]]
        factors = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - factors[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * factors % p).sum(1)) % p
    # Leading principal minors of x - h, by expanding the last column; below[i] is the product of the
    # entries under the diagonal from column i on.
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    below = np.ones(d, np.int64)
    for k in range(d):
        minors[k + 1, 1:] = minors[k, :-1]
        if k:
            below[:k] = below[:k] * h[k, k - 1] % p
        factors = h[: k + 1, k] * below[: k + 1] % p
        minors[k + 1] = (minors[k + 1] - (factors[:, None] * minors[: k + 1] % p).sum(0)) % p
    return minors[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Of a positive semidefinite integer matrix, lowest coefficient first; primes are Spark tasks."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_below(2**31, 2 * bound + 1)
    shared = spark.sparkContext.broadcast(matrix)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(shared.value, object)
        for batch in batches:
            own = batch.column(0).to_pylist()
            found = [polynomial_mod((whole % p).astype(np.int64), p) for p in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["p", "c"])

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    frame = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    coefficients, product = np.zeros(d + 1, object), 1
    for r in frame.mapInArrow(residues, "p long, c array<long>").collect():
        lift = (np.array(r.c, object) - coefficients) * pow(product, -1, r.p) % r.p
        coefficients = coefficients + product * lift
        product *= r.p
    return [int(c - product if 2 * c > product else c) for c in coefficients]


def roots_above(polynomial: list[int], a: int, shift: int) -> int:
    """How many roots, with multiplicity, are above a / 2**shift; all roots must be real."""
    d = len(polynomial) - 1
    c = [x << (shift * (d - i)) for i, x in enumerate(polynomial)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def isolate(polynomial: list[int], k: int) -> tuple[int, int, int, int]:
    """The k-th largest root r > 0: a, shift, first, count with a < r * 2**shift <= a + 1.

    ``first`` to ``first + count - 1`` are the numbers of all roots in that interval.
    """
    high = max(-polynomial[-2], 1).bit_length()  # the sum of the roots
    a, shift = 0, -high  # the interval is (a, a + 1] / 2**shift
    below, above = roots_above(polynomial, 0, 0), 0
    if below < k:
        raise ValueError(f"there are {below} positive roots")
    # A relative width: a has ROOT_BITS bits.
    while a.bit_length() < ROOT_BITS:
        a, shift = 2 * a, shift + 1
        middle = roots_above(polynomial, a + 1, shift) if shift >= 0 else roots_above(polynomial, (a + 1) << -shift, 0)
        if middle >= k:
            a, below = a + 1, middle
        else:
            above = middle
    return a, shift, above + 1, below - above


def null_vectors(matrix: list[list[int]], root: Decimal, count: int) -> list[np.ndarray]:
    """``count`` orthonormal vectors that the matrix less ``root`` takes next to zero."""
    d = len(matrix)
    tiny = (abs(root) + 1) * Decimal(10) ** -DIGITS
    a = np.array([[Decimal(x) for x in row] for row in matrix], object)
    for i in range(d):
        a[i, i] -= root
    order = list(range(d))
    for k in range(d):
        at = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        if at != k:
            a[[k, at]] = a[[at, k]]
            order[k], order[at] = order[at], order[k]
        if not a[k, k]:
            a[k, k] = tiny
        if k + 1 < d:
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])

    def solve(b: np.ndarray) -> np.ndarray:
        x = b[order]
        for i in range(1, d):
            x[i] -= (a[i, :i] * x[:i]).sum()
        for i in range(d - 1, -1, -1):
            if i + 1 < d:
                x[i] -= (a[i, i + 1 :] * x[i + 1 :]).sum()
            x[i] /= a[i, i]
        return x

    # Any start does that is not at right angles to the null space.
    found = [np.array([Decimal(1 + pow(3 + 2 * c, i + 1, 1009)) for i in range(d)], object) for c in range(count)]
    for _ in range(ITERATIONS):
        found = [solve(x) for x in found]
        for c, x in enumerate(found):
            for _ in range(2):
                for other in found[:c]:
                    x = x - other * (x * other).sum()
                x = x / (x * x).sum().sqrt()
            found[c] = x
    return found


def components(spark: SparkSession, matrix: list[list[int]], limit: int = COMPONENTS) -> list[tuple[Decimal, list[float]]]:
    """(eigenvalue, unit eigenvector) of the largest positive eigenvalues; each is a Spark task."""
    polynomial = characteristic_polynomial(spark, matrix)
    wanted = min(limit, roots_above(polynomial, 0, 0))
    if not wanted:
        return []
    shared = spark.sparkContext.broadcast((matrix, polynomial))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, poly = shared.value
        for batch in batches:
            rows = []
            for k in batch.column(0).to_pylist():
                a, shift, first, count = isolate(poly, k)
                with localcontext() as digits:
                    digits.prec = 2 * DIGITS
                    root = Decimal(2 * a + 1) / Decimal(2) ** (shift + 1)
                    x = null_vectors(whole, root, count)[k - first]
                    x = x if x[max(range(len(x)), key=lambda i: abs(x[i]))] > 0 else -x
                    rows.append((k, str(root), [float(v) for v in x]))
            k, root, x = zip(*rows) if rows else ((), (), ())
            kinds = (pa.int64(), pa.string(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((k, root, x), kinds)], names=["k", "root", "x"])

    # One component a task.
    numbers = spark.range(1, wanted + 1, 1, wanted).select(F.col("id").alias("k"))
    found = numbers.mapInArrow(solve, "k long, root string, x array<double>").collect()
    return [(Decimal(r.root), r.x) for r in sorted(found, key=lambda r: r.k)]


RESULT = "n long, deviation decimal(38,0), whitened array<double>"


def project(rows: DataFrame, vector: str, keep: list[str], total: Scatter, found: list[tuple[Decimal, list[float]]]) -> DataFrame:
    """``keep`` with each row's squared distance from the mean (times n**2) and its whitened vector."""
    n, d = total.n, len(total.sums)
    # With e the eigenvalue of n**2 times the covariance: (n x - S) v / n / sqrt(e / n**2).
    weights = np.array([[float(v) for v in x] for _, x in found]) / np.array([[float(e.sqrt())] for e, _ in found])
    names = [c for c in keep if c not in ("n", "deviation", "whitened")]
    ready = usable(rows, vector).filter(F.col("_d") == d).select(*names, "_x")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name != "_x"), RESULT])
    sums = np.array(total.sums, object)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                x = _integers(batch.column(len(names)), d)
                # Longs where they cannot overflow, else Python's integers.
                z = x.astype(object) * n - sums
                small = z.astype(np.int64) if max(abs(z.min()), abs(z.max())) ** 2 * d < 2**63 else z
                deviation = [Decimal(int(v)) for v in (small * small).sum(1)]
                deviation = [v if v.adjusted() < 38 else None for v in deviation]
                white = small.astype(np.float64) @ weights.T
                columns = [
                    pa.array(np.full(len(x), n, np.int64)),
                    pa.array(deviation, pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(weights), white.ravel()),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*names, "n", "deviation", "whitened"])

    return ready.mapInArrow(apply, schema)


def identity_error(white: DataFrame, count: int) -> float:
    """Largest entry of the whitened rows' covariance less the identity, as measured on the rows."""
    at = lambda i: F.get("whitened", F.lit(i))
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    measured = white.agg(*[F.covar_pop(at(i), at(j)) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(measured, pairs))


def whiten(
    rows: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), limit: int = COMPONENTS
) -> DataFrame:
    """``keep``, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    spark = rows.sparkSession
    names = [c for c in keep if c not in RESULTS]
    total = scatter(rows, vector)
    matrix = total.centred() if total else []
    found = components(spark, matrix, limit) if total else []
    if not found:
        kinds = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        own = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema), kinds])
        return spark.createDataFrame([], own)
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    white = saved(project(rows, vector, names, total, found), "whitened")
    error = identity_error(white, len(found))
    shares = F.array(*[F.lit(float(e / trace)) for e, _ in found])
    return white.select(*names, "n", "deviation", F.posexplode("whitened").alias("_k", "whitened")).select(
        *names,
        (F.col("_k") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get(shares, F.col("_k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")
