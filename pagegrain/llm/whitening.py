"""Embedding whitening by the exact characteristic polynomial of the integer scatter.

Entries become whole numbers, so the centred scatter ``A = n * sum(x x') - S S'`` is an
exact integer matrix. Its characteristic polynomial is worked out modulo one prime a
row: reduction to Hessenberg form, then the recurrence of Hessenberg determinants.
As many primes as a proven bound on the coefficients asks for give the polynomial by
Chinese remaindering. All its roots are real, so the sign changes of its coefficients
after a shift count the roots beyond the shift exactly, multiple roots included; they
isolate every root, and bisection refines it far below double precision. Inverse
iteration in fixed-point numbers then spans the null space of ``A - root * I``.

Vectors are read by Spark tasks alone. What comes to the driver are sums, residues
and components: numbers bounded by the square of the dimension.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm.common import cut

#: Components returned.
COMPONENTS = 32
#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Bits of a root beyond those of the largest; roots closer than half of them count as one, of several components.
BITS = 256
#: Largest whole number up to which doubles are exact.
EXACT = 1 << 53
#: Sums travel as digits in this base, which decimals add up without loss.
LIMB = 48


def usable(vector: Column) -> Column:
    """Not null, not empty, every entry there and finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def shifted(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) without the offset, as whole doubles; beyond the range of long as the nearest long."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -(2.0 ** 63), 2.0 ** 63 - 1024)


def whole(x: np.ndarray) -> np.ndarray:
    """Python integers of whole doubles."""
    return np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object)


def _matrices(batches: Iterable[pa.RecordBatch], d: int):
    for b in batches:
        if b.num_rows:
            vectors = b.column(b.schema.get_field_index("vector"))
            yield b, shifted(vectors.flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, d)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    k = 0
    while value not in (0, -1):
        yield k, value & ((1 << LIMB) - 1)
        value, k = value >> LIMB, k + 1
    if value:
        yield k, value


def _sums(d: int):
    """Exact sums of a task: rows (i, j, limb, value); j is -1 for the sum of entry i, i is -1 for the count."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])
    upper = [(i, j) for i in range(d) for j in range(i, d)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, [0] * d, [0] * len(upper)
        for _, x in _matrices(batches, d):
            n += len(x)
            if float(np.abs(x).max()) ** 2 * len(x) < EXACT:
                s, p = x.sum(axis=0), x.T @ x
            else:
                y = whole(x)
                s, p = y.sum(axis=0), y.T.dot(y)
            one = [a + int(b) for a, b in zip(one, s)]
            two = [a + int(p[ij]) for a, ij in zip(two, upper)]
        cells = [((-1, -1), n), *(((i, -1), v) for i, v in enumerate(one)), *zip(upper, two)] if n else []
        rows = [(i, j, k, v) for (i, j), value in cells for k, v in _limbs(value)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)
    return run


def scatter(vectors: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums of the shifted entries, and n * sum(x x') - S S', exact; by whole vectors of length d in ``vector``."""
    rows = (vectors.select("vector").mapInArrow(_sums(d), "i int, j int, limb int, value long").groupBy("i", "j", "limb")
            .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
    total: dict[tuple[int, int], int] = {}
    for r in rows:
        total[r["i"], r["j"]] = total.get((r["i"], r["j"]), 0) + (int(r["value"]) << (LIMB * r["limb"]))
    n = total.get((-1, -1), 0)
    s = [total.get((i, -1), 0) for i in range(d)]
    return n, s, [[n * total.get((min(i, j), max(i, j)), 0) - s[i] * s[j] for j in range(d)] for i in range(d)]


def polynomial_mod(a: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(x I - a) modulo the prime p < 2^31, constant first."""
    d = len(a)
    h = np.array([[v % p for v in row] for row in a], np.int64)
    for c in range(d - 2):
        pivots = np.flatnonzero(h[c + 1:, c])
        if not len(pivots):
            continue
        r = c + 1 + int(pivots[0])
        if r != c + 1:
            h[[r, c + 1]] = h[[c + 1, r]]
            h[:, [r, c + 1]] = h[:, [c + 1, r]]
        factor = h[c + 2:, c] * pow(int(h[c + 1, c]), -1, p) % p
        h[c + 2:] = (h[c + 2:] - factor[:, None] * h[c + 1] % p) % p
        for f, column in zip(factor.tolist(), range(c + 2, d)):  # one product at a time stays below 2^62
            if f:
                h[:, c + 1] = (h[:, c + 1] + f * h[:, column]) % p
    polys = [np.array([1], np.int64)]
    for k in range(1, d + 1):
        new = np.zeros(k + 1, np.int64)
        new[1:] = polys[k - 1]
        new[:k] = (new[:k] - h[k - 1, k - 1] * polys[k - 1]) % p
        product = 1
        for i in range(k - 1, 0, -1):
            product = product * int(h[i, i - 1]) % p
            if not product:
                break
            new[:i] = (new[:i] - int(h[i - 1, k - 1]) * product % p * polys[i - 1]) % p
        polys.append(new % p)
    return polys[d].tolist()


def _is_prime(n: int) -> bool:
    """Exact below 3.4e14."""
    if n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7, 11, 13, 17):
        x = pow(base, odd, n)
        if base % n and x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(bound: int) -> list[int]:
    """Primes below 2^31, largest first, whose product exceeds ``bound``."""
    out, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def coefficient_bound(trace: int, d: int) -> int:
    """No coefficient is larger: the k-th symmetric function of d numbers >= 0 is at most C(d, k) * (trace / d)^k."""
    return max(math.comb(d, k) * (trace ** k // d ** k + 1) for k in range(d + 1))


def remaindered(residues: dict[int, list[int]]) -> list[int]:
    """The numbers nearest to zero with these residues."""
    product = math.prod(residues)
    parts = {p: (product // p) * pow(product // p, -1, p) for p in residues}
    out = [sum(parts[p] * r for p, r in zip(residues, column)) % product for column in zip(*residues.values())]
    return [v - product if 2 * v > product else v for v in out]


def _polynomials(a: list[list[int]]):
    schema = pa.schema([("prime", pa.int64()), ("residues", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ps), pa.array([polynomial_mod(a, p) for p in ps], pa.list_(pa.int64()))], schema=schema)
    return run


def polynomial(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """Exact coefficients of det(x I - a) of a positive semidefinite integer matrix, constant first; a prime a row."""
    ps = primes(2 * coefficient_bound(sum(a[i][i] for i in range(len(a))), len(a)))
    rows = spark.createDataFrame([(p,) for p in ps], "prime long").repartition(min(len(ps), 16), "prime").mapInArrow(_polynomials(a), "prime long, residues array<long>")
    return remaindered({r["prime"]: r["residues"] for r in rows.collect()})


def roots_above(poly: list[int], at: int, bits: int) -> int:
    """Number of roots beyond at / 2^bits, with multiplicity; exact for a polynomial whose roots are all real."""
    d = len(poly) - 1
    c = [v << (bits * (d - k)) for k, v in enumerate(poly)]  # roots times 2^bits
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def roots(poly: list[int], count: int, bits: int = BITS) -> tuple[int, list[tuple[int, int]]]:
    """Binary places, and the ``count`` largest positive roots as (root * 2^places, multiplicity), falling.

    ``poly`` has real roots >= 0 alone. Intervals are halved by exact root counts until
    they hold one root or are narrower than half the bits, then by the sign at the middle.
    """
    zeros = next(k for k, v in enumerate(poly) if v)
    poly = poly[zeros:]
    degree = len(poly) - 1
    if not degree:
        return 0, []
    top = -poly[-2] + 1
    places = max(0, bits - top.bit_length())
    high, least = top << places, max(1, (top << places) >> (bits // 2))
    counts = {0: degree, high: 0}

    def beyond(x: int) -> int:
        if x not in counts:
            counts[x] = roots_above(poly, x, places)
        return counts[x]

    scaled = [v << (places * (degree - k)) for k, v in enumerate(poly)]

    def sign(x: int) -> int:
        value = 0
        for c in reversed(scaled):
            value = value * x + c
        return (value > 0) - (value < 0)

    found: list[tuple[int, int]] = []
    todo = [(0, high)]
    while todo and sum(m for _, m in found) < count:
        lo, hi = todo.pop()  # roots in (lo, hi]
        here = beyond(lo) - beyond(hi)
        if not here:
            continue
        mid = (lo + hi) // 2
        if here > 1 and hi - lo > least:
            todo += [(lo, mid), (mid, hi)]
            continue
        if here > 1:
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if beyond(mid) - beyond(hi) == here else (lo, mid)
                if beyond(lo) - beyond(hi) != here:
                    break
        else:
            upper = sign(hi)
            while upper and hi - lo > 1:
                mid = (lo + hi) // 2
                now = sign(mid)
                if now == 0:
                    lo, hi = mid - 1, mid
                    break
                lo, hi = (lo, mid) if now == upper else (mid, hi)
        found.append((hi, here))
    return places, found


def null_space(a: list[list[int]], root: int, places: int, size: int, rounds: int = 3) -> list[list[float]]:
    """``size`` orthonormal vectors that a maps to root / 2^places times themselves, by inverse iteration in fixed-point numbers."""
    d = len(a)
    work = 2 * max(v.bit_length() for row in a for v in row) + BITS
    one = 1 << work
    m = [[(v << work) - ((root << work >> places) if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(a)]
    order = list(range(d))
    for c in range(d):
        best = max(range(c, d), key=lambda r: abs(m[r][c]))
        m[c], m[best], order[c], order[best] = m[best], m[c], order[best], order[c]
        pivot = m[c][c] = m[c][c] or 1  # the matrix is singular to the last place: the smallest step stands for zero
        for r in range(c + 1, d):
            if m[r][c]:
                f = m[r][c] = (m[r][c] << work) // pivot
                m[r][c + 1:] = [x - (f * y >> work) for x, y in zip(m[r][c + 1:], m[c][c + 1:])]
    rng = np.random.default_rng(0)
    basis = [[int(x) << (work - 30) for x in rng.integers(-(1 << 30), 1 << 30, d)] for _ in range(size)]

    def solved(b: list[int]) -> list[int]:
        y = [b[i] for i in order]
        for r in range(d):
            y[r] -= sum(m[r][c] * y[c] for c in range(r)) >> work
        for r in range(d - 1, -1, -1):
            y[r] = ((y[r] << work) - sum(m[r][c] * y[c] for c in range(r + 1, d))) // m[r][r]
        return y

    def unit(v: list[int]) -> list[int]:
        spare = max(0, max(abs(x).bit_length() for x in v) - 2 * work)
        v = [x >> spare for x in v]
        length = math.isqrt(sum(x * x for x in v))
        return [(x << work) // length for x in v]

    for _ in range(rounds):
        new: list[list[int]] = []
        for v in map(unit, map(solved, basis)):
            for _ in range(2):
                for u in new:
                    along = sum(x * y for x, y in zip(u, v)) >> work
                    v = [y - (along * x >> work) for x, y in zip(u, v)]
                v = unit(v)
            new.append(v)
        basis = new
    return [[x / one for x in v] for v in basis]


def _components(a: list[list[int]], places: int):
    schema = pa.schema([("number", pa.int32()), ("vectors", pa.list_(pa.list_(pa.float64())))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, root, size in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([null_space(a, int(root), places, size)], schema[1].type)], schema=schema)
    return run


def components(spark: SparkSession, a: list[list[int]], count: int = COMPONENTS) -> list[tuple[float, list[float]]]:
    """Largest eigenvalues above 0 of the scatter with a unit eigenvector each, falling; a root a row."""
    if not any(a[i][i] for i in range(len(a))):
        return []
    places, found = roots(polynomial(spark, a), count)
    rows = spark.createDataFrame([(k, str(r), m) for k, (r, m) in enumerate(found)], "number int, root string, size int")
    spread = rows.repartition(max(1, min(len(found), 16)), "number").mapInArrow(_components(a, places), "number int, vectors array<array<double>>")
    vectors = {r["number"]: r["vectors"] for r in spread.collect()}
    return [(root / (1 << places), list(v)) for k, (root, _) in enumerate(found) for v in vectors[k]][:count]


def _projected(d: int, n: int, sums: list[int], directions: np.ndarray, first: int):
    """Adds ``deviation`` and ``whitened`` to the ``first`` columns."""
    mean = np.array(sums, object)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _matrices(batches, d):
            reach = float(np.abs(x).max()) * n + max(map(abs, sums))
            if reach < EXACT and reach * reach * d < 2 ** 63:
                y = x.astype(np.int64) * n - mean.astype(np.int64)
                deviation = [int(v) for v in (y * y).sum(axis=1)]
            else:
                y = whole(x) * n - mean
                deviation = (y * y).sum(axis=1).tolist()
            z = y.astype(np.float64) @ directions.T
            k = len(directions)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * k, pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:first], pa.array([str(v) for v in deviation]), lists], names=[*b.schema.names[:first], "deviation", "whitened"])
    return run


def _products(k: int, mean: np.ndarray):
    schema = pa.schema([("cell", pa.int32()), ("value", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            z = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k) - mean
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel())], schema=schema)
    return run


def identity_error(rows: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` less the identity, centred before multiplying."""
    means = rows.select(F.posexplode("whitened").alias("component", "value")).groupBy("component").agg(F.sum("value").alias("total")).collect()
    mean = np.zeros(k)
    for r in means:
        mean[r["component"]] = r["total"] / n
    cells = rows.select("whitened").mapInArrow(_products(k, mean), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    covariance = np.zeros(k * k)
    for r in cells:
        covariance[r["cell"]] = r["value"] / n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """Every usable vector's id with ``n``, ``deviation`` (exact, as text: it may
    have any number of digits), ``whitened`` and ``explained`` (arrays by component) and ``identity_error``.

    Vectors that are null, empty or hold null or non-finite entries are left out, as
    are those of another length than most have (of equally common lengths the
    longest stays). Every row counts: repeated ids, repeated vectors and null ids give
    rows of their own. Directions without variance give no component; when no
    direction has any (an empty table, one row, equal rows), the arrays are empty and
    the error is null. Other columns are not read.
    """
    spark = embeddings.sparkSession
    good = embeddings.select(F.col(key).alias("id"), F.col(vector).alias("vector")).where(usable(F.col("vector")))
    kind = good.schema["id"].dataType.simpleString()
    length = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = length["d"] if length else 1
    good = good.where(F.size("vector") == d)
    n, sums, a = scatter(good, d)
    found = components(spark, a, count)
    directions = np.array([np.array(v) / math.sqrt(e) for e, v in found]).reshape(len(found), d)
    trace = sum(a[i][i] for i in range(d))
    rows = cut(good.mapInArrow(_projected(d, n, sums, directions, 1), f"id {kind}, deviation string, whitened array<double>"), "whitened")
    error = F.lit(identity_error(rows, n, len(found)) if found else None).cast("double")
    explained = F.array(*[F.lit(e / trace) for e, _ in found]) if found else F.array().cast("array<double>")
    return rows.select(F.col("id").alias(key), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       explained.alias("explained"), error.alias("identity_error"))
