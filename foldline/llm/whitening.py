"""Embedding whitening from an exact scatter matrix in residues.

Components become integers, and the scatter of the integers, centred at the whole number nearest to their mean, is
computed without rounding: each task multiplies its centred rows modulo several primes, as products of doubles that
stay below 2**53, and sends one residue matrix for each prime. Residues are added modulo their prime, and the
sums are put together by the Chinese remainder theorem: there are as many primes as the largest entry that the rows
allow asks for. From the exact sums the covariance is a quotient of two integers, rounded once, and its eigenvectors
whiten every row in double precision. The driver holds matrices of columns times columns, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.shared import cut

#: x = floor(GRID * c) + SHIFT; components returned at most.
GRID, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Largest absolute x: a component beyond is set to it.
LARGEST = 1 << 61
#: Residues lie between -PRIME_BITS' half and half, and this many rows are multiplied at a time, so that sums stay below 2**53.
PRIME_BITS, ROWS = 20, 8192
#: An eigenvalue is zero if it is smaller than this share of the largest.
ZERO = 1e-13


def primes(bits: int) -> Iterator[int]:
    """Primes below 2**bits, largest first."""
    for p in range((1 << bits) - 1, 2, -2):
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            yield p


def enough_primes(bound: int) -> list[int]:
    """The largest primes whose product tells numbers from -bound to bound apart."""
    found, product = [], 1
    for p in primes(PRIME_BITS):
        if product > 2 * bound:
            break
        found.append(p)
        product *= p
    return found


def from_residues(residues: list[int], moduli: list[int]) -> int:
    """The number of least absolute value with these residues."""
    x, m = 0, 1
    for r, p in zip(residues, moduli):
        x += m * ((r - x) * pow(m, -1, p) % p)
        m *= p
    return x if 2 * x <= m else x - m


def grid(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers from rows of components."""
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    return np.clip(np.floor(np.clip(c, -LARGEST, LARGEST) * GRID), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def column_sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Of each batch, a row per dimension: dim, n, the sums of x's upper and lower 32 bits, least and largest x."""
    for batch in batches:
        if batch.num_rows:
            x = grid(batch.column(0), width)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.arange(width), np.full(width, len(x)), (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), x.min(0), x.max(0))], ["dim", "n", "high", "low", "least", "most"])


def residue_scatter(batches: Iterator[pa.RecordBatch], width: int, centre: np.ndarray, moduli: list[int]) -> Iterator[pa.RecordBatch]:
    """prime, row, sums: of a task's rows z = x - centre, row by row the sums of z z' modulo each prime."""
    total = np.zeros((len(moduli), width, width), np.int64)
    held: list[np.ndarray] = []

    def add() -> None:
        z = np.concatenate(held)
        held.clear()
        for k, p in enumerate(moduli):
            r = z % p
            r = np.where(r > p // 2, r - p, r).astype(np.float64)
            for at in range(0, len(r), ROWS):
                part = r[at : at + ROWS]
                total[k] = (total[k] + (part.T @ part).astype(np.int64)) % p

    for batch in batches:
        if batch.num_rows:
            held.append(grid(batch.column(0), width) - centre)
            if sum(map(len, held)) >= ROWS:
                add()
    if held:
        add()
    for k in range(len(moduli)):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(width, k)), pa.array(np.arange(width)), pa.array([row.tobytes() for row in total[k]], pa.binary())], ["prime", "row", "sums"])


def add_residues(batches: Iterator[pa.RecordBatch], moduli: list[int]) -> Iterator[pa.RecordBatch]:
    """The sums of rows of one prime and row, modulo the prime; a row for each that the task meets."""
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for k, row, sums in zip(*(batch.column(c).to_pylist() for c in range(3))):
            own = np.frombuffer(sums, np.int64)
            total[k, row] = (total[k, row] + own) % moduli[k] if (k, row) in total else own
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total]), pa.array([r for _, r in total]), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["prime", "row", "sums"])


class Fit:
    """n, the exact sums S, and the exact n * n * covariance of the fit list's x; eigenvectors in columns, largest eigenvalue first."""

    def __init__(self, n: int, sums: list[int], scatter: list[list[int]]):
        self.n, self.sums, self.scatter = n, sums, scatter
        cov = np.array([[value / (n * n) for value in row] for row in scatter])  # a quotient of integers, rounded once
        values, vectors = np.linalg.eigh((cov + cov.T) / 2)
        self.values, self.vectors = values[::-1], vectors[:, ::-1]
        self.trace = sum(scatter[i][i] for i in range(len(sums))) / (n * n)
        self.kept = int((self.values > ZERO * max(self.values[0], 0)).sum())  # the others have no spread to divide by


def scatter_of(vectors: DataFrame, width: int) -> Fit | None:
    """The fit of all rows of a column of arrays of one width; None without rows."""
    each = vectors.mapInArrow(partial(column_sums, width=width), "dim long, n long, high long, low long, least long, most long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    dims = each.groupBy("dim").agg(F.sum("n").alias("n"), whole("high"), whole("low"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy("dim").collect()
    if not dims:
        return None
    n, sums = dims[0]["n"], [(int(d["high"]) << 32) + int(d["low"]) for d in dims]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    bound = max(max(abs(d["most"] - m), abs(d["least"] - m)) for d, m in zip(dims, centre))
    moduli = enough_primes(n * bound * bound)
    made = vectors.mapInArrow(partial(residue_scatter, width=width, centre=np.array(centre), moduli=moduli), "prime long, row long, sums binary")
    rows = made.repartition("prime", "row").mapInArrow(partial(add_residues, moduli=moduli), "prime long, row long, sums binary").collect()
    residues = np.zeros((len(moduli), width, width), object)
    for r in rows:
        residues[r["prime"], r["row"]] = np.frombuffer(r["sums"], np.int64).tolist()
    raw = [[from_residues([int(residues[k, i, j]) for k in range(len(moduli))], moduli) for j in range(width)] for i in range(width)]
    rest = [s - n * m for s, m in zip(sums, centre)]  # sums of the centred rows
    return Fit(n, sums, [[n * raw[i][j] - rest[i] * rest[j] for j in range(width)] for i in range(width)])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S)**2 of each row, exact."""
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, centre)]
    z = x - np.array(centre)
    most = n * int(np.abs(z).max(initial=0)) + max(map(abs, rest), default=0)
    if most * most * len(sums) < 1 << 62:
        y = n * z - np.array(rest)
        return (y * y).sum(1).tolist()
    return [sum((n * a - b) ** 2 for a, b in zip(row, rest)) for row in z.tolist()]


def whitened(x: np.ndarray, fit: Fit, components: int) -> np.ndarray:
    """x - S / n on the components, over the roots of their eigenvalues; no number for components without spread."""
    whole = [s // fit.n for s in fit.sums]
    part = np.array([(s - fit.n * m) / fit.n for s, m in zip(fit.sums, whole)])
    kept = min(components, fit.kept)
    out = np.full((len(x), components), np.nan)
    with np.errstate(all="ignore"):
        out[:, :kept] = ((x - np.array(whole)) - part) @ fit.vectors[:, :kept] / np.sqrt(fit.values[:kept])
    return out


def moments(batches: Iterator[pa.RecordBatch], width: int, fit: Fit, components: int) -> Iterator[pa.RecordBatch]:
    """A task's n, sums and products of whitened rows, about zero, which is their mean but for rounding."""
    n, sums, products = 0, np.zeros(components), np.zeros((components, components))
    for batch in batches:
        w = np.nan_to_num(whitened(grid(batch.column(0), width), fit, components))
        n, sums, products = n + len(w), sums + w.sum(0), products + w.T @ w
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))], ["n", "sums", "products"])


def identity_error(vectors: DataFrame, width: int, fit: Fit, components: int) -> float | None:
    """The largest absolute entry of the whitened rows' covariance less the identity, over components that have spread."""
    parts = vectors.mapInArrow(partial(moments, width=width, fit=fit, components=components), "n long, sums array<double>, products array<double>")
    flat = parts.select(F.posexplode(F.concat("sums", "products")).alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
    got = {r["at"]: r["value"] for r in flat.collect()}  # components + components ** 2 numbers
    total = np.array([got[k] for k in range(components)])
    products = np.array([got[components + k] for k in range(components**2)]).reshape(components, components)
    cov = products / fit.n - np.outer(total, total) / fit.n**2
    kept = min(components, fit.kept)
    return float(np.abs(cov - np.eye(components))[:kept, :kept].max()) if kept else None


RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, folder: str, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    embeddings: vec_id and an array column; other columns are not read. folder: a shared folder for this run's table. Null and empty
    vectors and those with null or non-finite components are left out; if lengths differ, the most frequent one (the
    shorter of two as frequent) is kept. x is floor(64 * c) + 1000000, and beyond 2**61 that number. There are as many components as
    dimensions, up to `components`. deviation is null beyond 38 digits; whitened is null on components without spread (all of them if
    there is one row, or all are equal), where explained is 0, or null if there is no spread at all. Components of equal eigenvalue
    are some orthogonal choice. Null and repeated ids are rows like others. An empty table gives no rows.
    """
    vector = F.col(column).cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(F.size("vector") > 0)
    rows = rows.where(F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    rows = cut(rows, f"{folder}/vectors")
    lengths = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    width = lengths[0]["width"] if lengths else 1
    rows = rows.where(F.size("vector") == width)
    fit = scatter_of(rows.select("vector"), width)
    if fit is None:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    components = min(components, width)
    error = identity_error(rows.select("vector"), width, fit, components)
    trace, shares = fit.trace, [float(v / fit.trace) if fit.trace > 0 else None for v in np.where(np.arange(width) < fit.kept, fit.values, 0)[:components]]
    n, sums = fit.n, fit.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = grid(batch.column(1), width)
            w = whitened(x, fit, components).ravel()
            far = pa.array([str(d) if d < 10**38 else None for d in deviations(x, n, sums)], pa.string()).cast(pa.decimal128(38, 0))
            times, size = np.repeat(np.arange(len(x)), components), len(w)
            columns = [batch.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), len(x))), pa.array(np.full(size, n)), far.take(pa.array(times)), pa.array(w, mask=np.isnan(w)), pa.array(shares * len(x), pa.float64()), pa.array([error] * size, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return rows.mapInArrow(run, RESULT)
