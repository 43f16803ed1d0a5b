"""Whitening of embeddings by exact covariances from bit planes.

Each component c becomes the whole number x = floor(scale * c) + offset. A task takes its vectors' least x of each dimension, writes what lies above it as
binary digits, and packs each digit of a dimension, over all rows, into 64-bit words: its bit planes. The product of two dimensions summed over
rows is then the sum over all pairs of their planes of 2^(a + b) times the set bits of the two planes' AND, which is exact. Counts are added up by dimension pair
and by a + b in Spark, shifts and all else on the driver in Python's integers: n * sum(x y) - sum(x) sum(y), centred before anything is
rounded. The covariance that goes to ``eigh`` is that over n^2, each entry rounded once. Where eigenvalues lie so far
apart that eigh's error would show in the small ones, Jacobi rotations in extended precision follow.

What the driver holds is one number for each pair of dimensions and each a + b, whatever the number of rows.

Defined results: vectors that are null, empty, or hold a null, a non-finite component or one whose x a long does not hold take no part and have no rows;
only vectors of the commonest length (ties: the smaller) are fitted and whitened; rows that repeat count each, as do ids; a null id is kept;
``deviation`` is exact, and the nearest long where it is beyond 64 bits; a component whose eigenvalue is zero up to rounding has null as its whitened value and no part in
``identity_error``, which is null where no component is left; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.llm.common import small_batches
from noticeflow.llm.vectors import LEAST, MOST, sound

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Numbers of a slice whose planes are made at a time; a task's sums do not grow with it.
NUMBERS = 1 << 22
#: Exact sums travel as so many parts of 32 bits, of which the last has the sign; Spark adds up parts.
PARTS = 6
#: Below this share of the greatest eigenvalue eigh's error shows in a component, and rotations follow.
GRADED = 1e-8


def whole_numbers(data: np.ndarray, scale: int = SCALE, offset: int = OFFSET) -> np.ndarray:
    return np.floor(scale * data.astype(np.float64)).astype(np.int64) + offset


def planes(y: np.ndarray, digits: int) -> np.ndarray:
    """(dimension, digit, word): bit planes of non-negative numbers, 64 rows a word."""
    n, dim = y.shape
    out = np.zeros((dim, digits, -(-n // 64) * 8), np.uint8)
    for b in range(digits):
        bits = ((y >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        out[:, b, : -(-n // 8)] = np.packbits(bits, axis=0).T
    return out.view(np.uint64)


def pair_counts(p: np.ndarray) -> np.ndarray:
    """[i, j, w] for j >= i: set bits of the ANDs of planes a of i and b of j, summed over a + b = w."""
    dim, digits, _ = p.shape
    out = np.zeros((dim, dim, 2 * digits - 1), np.int64)
    for i in range(dim):
        for a in range(digits):
            if p[i, a].any():
                out[i, i:, a : a + digits] += np.bitwise_count(p[i:] & p[i, a]).sum(axis=2, dtype=np.int64)
    return out


def _weighted(counts: np.ndarray) -> list:
    """Each row's counts times the powers of two that they stand for, as Python's integers."""
    weights = [1 << w for w in range(counts.shape[-1])]
    return [sum(c * w for c, w in zip(row, weights, strict=True) if c) for row in counts.reshape(-1, counts.shape[-1]).tolist()]


def scatter(x: np.ndarray) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, products) of whole numbers, exact: products[i][j] = sum of x_i x_j over the rows."""
    n, dim = x.shape
    least = x.min(axis=0)
    y = x.astype(np.uint64) - least.astype(np.uint64)  # modulo 2**64, so right for any two longs
    p = planes(y, max(1, int(y.max()).bit_length()))
    counts = pair_counts(p)
    shift = least.tolist()
    ones = np.bitwise_count(p).sum(axis=2, dtype=np.int64)
    of_y = _weighted(ones)
    flat = _weighted(counts)
    sums = [s + n * m for s, m in zip(of_y, shift, strict=True)]
    products = [[0] * dim for _ in range(dim)]
    for i in range(dim):
        for j in range(i, dim):
            products[i][j] = flat[i * dim + j] + shift[i] * of_y[j] + shift[j] * of_y[i] + n * shift[i] * shift[j]
    return n, sums, products


def parted(v: int) -> list[int]:
    return [(v >> 32 * k) & 0xFFFFFFFF for k in range(PARTS - 1)] + [v >> 32 * (PARTS - 1)]


def joined(parts: list[int]) -> int:
    return sum(p << 32 * k for k, p in enumerate(parts))


def _slices(batches: Iterator[pa.RecordBatch], column: str, dim: int, rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _scatter(batches: Iterator[pa.RecordBatch], dim: int, scale: int, offset: int) -> Iterator[pa.RecordBatch]:
    """A row of each dimension at the end of the task: n, and the parts of its sum and of its products with itself and all later ones."""
    n, sums, products = 0, [0] * dim, [[0] * dim for _ in range(dim)]
    kept: list[np.ndarray] = []
    rows = max(64, NUMBERS // dim)

    def add() -> None:
        nonlocal n, sums
        count, s, p = scatter(np.concatenate(kept))
        n, sums = n + count, [x + y for x, y in zip(sums, s, strict=True)]
        for i in range(dim):
            products[i] = [x + y for x, y in zip(products[i], p[i], strict=True)]
        kept.clear()

    for _, data in _slices(batches, "v", dim, rows):
        kept.append(whole_numbers(data, scale, offset))
        if sum(map(len, kept)) >= rows:
            add()
    if kept:
        add()
    if n:
        parts = [[p for v in (sums[i], *products[i][i:]) for p in parted(v)] for i in range(dim)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim), pa.int32()), "n": pa.array([n] * dim, pa.int64()), "parts": pa.array(parts, pa.list_(pa.int64()))})


def rotated(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) by Jacobi rotations in extended precision, which keeps small eigenvalues exact relative to
    their own dimensions' spread."""
    a = v.astype(np.longdouble)
    q = np.eye(len(a), dtype=np.longdouble)
    for _ in range(60):
        turned = False
        for i in range(len(a) - 1):
            for j in range(i + 1, len(a)):
                if a[i, j] == 0 or abs(a[i, j]) <= 1e-18 * np.sqrt(abs(a[i, i] * a[j, j])):
                    continue
                turned = True
                t = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = (1 if t >= 0 else -1) / (abs(t) + np.sqrt(1 + t * t))
                c = 1 / np.sqrt(1 + t * t)
                turn = np.array([[c, t * c], [-t * c, c]])
                a[:, [i, j]] = a[:, [i, j]] @ turn
                a[[i, j]] = turn.T @ a[[i, j]]
                a[i, j] = a[j, i] = 0
                q[:, [i, j]] = q[:, [i, j]] @ turn
        if not turned:
            break
    return np.diag(a).copy(), q


@dataclass
class Fit:
    """What is known of the fit list: exact sums, and the components in order of falling eigenvalue."""

    n: int
    dim: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray  # columns
    alive: np.ndarray  # components that are not zero up to rounding

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where they fit, else Python's integers."""
        if max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0)))) * self.n + max(map(abs, self.sums)) <= MOST:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        scale = np.where(self.alive, np.sqrt(np.where(self.alive, self.values, 1)), np.nan)
        return ((centred / self.n).astype(np.float64) @ self.vectors) / scale

    def deviation(self, centred: np.ndarray) -> np.ndarray:
        most = max(abs(int(centred.min(initial=0))), abs(int(centred.max(initial=0))))
        if most * most * self.dim <= MOST:
            return (centred * centred).sum(axis=1)
        near = (centred.astype(np.float64) ** 2).sum(axis=1)
        return np.array([MOST if f > 1.01 * MOST else max(LEAST, min(MOST, sum(v * v for v in row.tolist()))) for f, row in zip(near, centred, strict=True)], np.int64)


def fitted(n: int, sums: list[int], products: list[list[int]], components: int = COMPONENTS) -> Fit:
    """Components of the exact covariance; products[i][j] for j >= i."""
    dim = len(sums)
    exact = [[n * products[min(i, j)][max(i, j)] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    v = np.array([[c / (n * n) for c in row] for row in exact])
    e, q = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:components]
    alive = np.ones(len(order), bool)
    if e[order].min() < GRADED * e[order].max(initial=0) or e[order].max(initial=0) <= 0:
        by_size = np.argsort(-np.diag(v), kind="stable")
        values, ways = rotated(v[np.ix_(by_size, by_size)])
        order = np.argsort(-values, kind="stable")[:components]
        e, q = values.astype(np.float64), np.empty_like(v)
        q[by_size] = ways.astype(np.float64)
        # what its own dimensions' spread would have as rounding
        alive = e[order] > 1e-16 * dim * ((q[:, order] ** 2) * np.diag(v)[:, None]).sum(axis=0)
    return Fit(n, dim, sums, sum(exact[i][i] for i in range(dim)) / (n * n), e[order], q[:, order], alive)


def _usable(df: DataFrame, vector: str, scale: int, offset: int) -> DataFrame:
    v = F.col(vector)
    fits = F.forall(v, lambda x: F.abs(F.floor(x.cast("double") * scale).cast("double")) < float((1 << 63) - (1 << 12) - abs(offset)))
    return df.where(sound(v) & fits)


def _moments(batches: Iterator[pa.RecordBatch], fit: Fit, scale: int, offset: int) -> Iterator[pa.RecordBatch]:
    """Of the task's whitened vectors: n, the mean, and the products centred by it."""
    n, mean, m2 = 0, np.zeros(len(fit.values)), np.zeros((len(fit.values),) * 2)
    for _, data in _slices(batches, "v", fit.dim, max(64, NUMBERS // fit.dim)):
        w = fit.whitened(fit.centred(whole_numbers(data, scale, offset)))
        k, middle = len(w), w.mean(axis=0)
        d, w = middle - mean, w - middle
        m2 += w.T @ w + np.outer(d, d) * (n * k / (n + k))
        n, mean = n + k, mean + d * (k / (n + k))
    if n:
        values = [n, *(n * mean), *(m2 + n * np.outer(mean, mean)).ravel()]
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(values)), pa.int32()), "value": pa.array(values, pa.float64())})


def _rows(batches: Iterator[pa.RecordBatch], fit: Fit, identity_error: float | None, scale: int, offset: int) -> Iterator[pa.RecordBatch]:
    k = len(fit.values)
    explained = fit.values / fit.trace if fit.trace > 0 else np.zeros(k)
    for part, data in _slices(batches, "v", fit.dim, max(64, (1 << 18) // max(k, fit.dim))):
        m = len(data)
        centred = fit.centred(whole_numbers(data, scale, offset))
        white = fit.whitened(centred).ravel()
        yield pa.RecordBatch.from_pydict({
            "vec_id": part.column("id").take(pa.array(np.repeat(np.arange(m), k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
            "n": pa.array(np.full(m * k, fit.n, np.int64)), "deviation": pa.array(np.repeat(fit.deviation(centred).astype(np.int64), k)),
            "whitened": pa.array(white, mask=np.isnan(white)), "explained": pa.array(np.tile(explained, m)),
            "identity_error": pa.array([identity_error] * (m * k), pa.float64()),
        })


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Fit | None:
    """The components of all usable vectors of the commonest length; None where there are none."""
    small_batches(vectors.sparkSession, rows=10_000)
    usable = _usable(vectors, vector, scale, offset)
    common = usable.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if not common:
        return None
    dim = common["dim"]
    of_tasks = usable.where(F.size(vector) == dim).select(F.col(vector).alias("v")).mapInArrow(
        partial(_scatter, dim=dim, scale=scale, offset=offset), "i int, n long, parts array<long>"
    )
    parts = of_tasks.select("i", "n", F.posexplode("parts").alias("at", "part")).groupBy("i", "at").agg(F.sum("n").alias("n"), F.sum("part").alias("part"))
    rows: dict[int, list] = {i: [0] * ((dim - i + 1) * PARTS) for i in range(dim)}
    n = 0
    for r in parts.toLocalIterator():  # a number of parts for each pair of dimensions
        rows[r["i"]][r["at"]], n = r["part"], r["n"]
    numbers = {i: [joined(p[k : k + PARTS]) for k in range(0, len(p), PARTS)] for i, p in rows.items()}
    return fitted(n, [numbers[i][0] for i in range(dim)], [[0] * i + numbers[i][1:] for i in range(dim)], components)


def whiten(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET,
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable vector and component."""
    spark = vectors.sparkSession
    schema = T.StructType([
        T.StructField("vec_id", vectors.schema[vec_id].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    known = fit(vectors, vector, components, scale, offset)
    if known is None:
        return spark.createDataFrame([], schema)
    rows = _usable(vectors, vector, scale, offset).where(F.size(vector) == known.dim).select(F.col(vec_id).alias("id"), F.col(vector).alias("v"))
    return rows.mapInArrow(partial(_rows, fit=known, identity_error=_identity_error(rows.select("v"), known, scale, offset), scale=scale, offset=offset), schema)


def _identity_error(rows: DataFrame, known: Fit, scale: int, offset: int) -> float | None:
    """The largest absolute entry of the whitened vectors' covariance less the identity, measured on all of them."""
    k = len(known.values)
    found = rows.mapInArrow(partial(_moments, fit=known, scale=scale, offset=offset), "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    values = np.zeros(1 + k + k * k)
    for r in found.collect():  # a number for each pair of components
        values[r["at"]] = r["value"]
    n, mean = values[0], values[1 : 1 + k] / values[0]
    covariance = values[1 + k :].reshape(k, k) / n - np.outer(mean, mean)
    some = covariance[np.ix_(known.alive, known.alive)] - np.eye(int(known.alive.sum()))
    return float(np.abs(some).max()) if some.size else None
