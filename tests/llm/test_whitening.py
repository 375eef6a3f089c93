import math
from decimal import Decimal

import numpy as np
import pytest

from foldline.llm import whitening
from foldline.llm.shared import work_dir
from foldline.llm.whitening import enough_primes, from_residues, whiten


def brute(vectors: dict, components: int = 32):
    """Exact sums in Python's integers; id -> deviation, and eigenvalues and whitened rows up to their signs."""
    x = {k: [math.floor(64 * float(c)) + 1_000_000 for c in v] for k, v in vectors.items()}
    n, d = len(x), len(next(iter(x.values())))
    s = [sum(v[i] for v in x.values()) for i in range(d)]
    y = {k: [n * v[i] - s[i] for i in range(d)] for k, v in x.items()}
    cov = np.array([[sum(v[i] * v[j] for v in y.values()) / n**3 for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    own = {k: np.array([c / n for c in v]) @ axes / np.sqrt(np.maximum(values, 1e-300)) for k, v in y.items()}
    return {k: sum(c * c for c in v) for k, v in y.items()}, values, own


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, vector string, sums string")


def test_against_exact_sums(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((7, 7)) * np.arange(1, 8)
    vectors = {k: (rng.standard_normal(7) @ base).tolist() for k in range(300)}
    odd = [(900, None, 0, "", ""), (901, [], 0, "", ""), (902, [1.0, None] + [0.0] * 5, 0, "", ""), (903, [math.inf] * 7, 0, "", ""), (904, [math.nan] * 7, 0, "", ""), (905, [1.0], 0, "", "")]
    rows = [(k, v, 0, "", "") for k, v in vectors.items()]
    rows += [(-5, vectors[3], 1, "", "")]  # a copy with a negative id
    got = whiten(frame(spark, rows + odd).repartition(5), work_dir(spark, "t")).collect()
    deviation, values, own = brute(vectors | {-5: vectors[3]})
    assert len(got) == 301 * 7 and {r.vec_id for r in got} == set(deviation)
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        want = own[r.vec_id][r.component - 1]
        sign = signs.setdefault(r.component, 1 if want * r.whitened >= 0 else -1)
        assert r.whitened == pytest.approx(sign * want, rel=1e-6, abs=1e-9)
        assert r.n == 301 and r.deviation == Decimal(deviation[r.vec_id])
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
        assert 0 <= r.identity_error < 1e-8


def test_on_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = whiten(table, work_dir(spark, "t")).toPandas()
    deviation, values, own = brute({r.vec_id: r.embedding for r in table.collect()})
    assert len(got) == len(deviation) * 32 and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-4
    assert {int(a): int(b) for a, b in zip(got["vec_id"], got["deviation"])} == deviation
    for c, rows in got.groupby("component"):
        want = np.array([own[k][c - 1] for k in rows["vec_id"]])
        np.testing.assert_allclose(rows["whitened"].to_numpy() * np.sign(want @ rows["whitened"].to_numpy()), want, atol=1e-6)
        np.testing.assert_allclose(rows["explained"], values[c - 1] / values.sum(), rtol=1e-9)


def test_large_numbers_take_more_primes(spark):
    """Sums far beyond 64 bits are exact; components beyond the range are set to its end."""
    vectors = {1: [2.0**40, 1.0], 2: [-(2.0**40), 2.0], 3: [0.5, 1e3], 4: [2.0**50 + 1, -(2.0**44)]}
    got = {r.vec_id: r.deviation for r in whiten(frame(spark, [(k, v, 0, "", "") for k, v in vectors.items()]), work_dir(spark, "t")).collect()}
    assert got == {k: Decimal(v) if v < 10**38 else None for k, v in brute(vectors)[0].items()}
    far = whiten(frame(spark, [(1, [1e308, 0.0], 0, "", ""), (2, [-1e308, 1.0], 0, "", "")]), work_dir(spark, "t")).collect()
    assert len(far) == 4 and all(math.isfinite(r.whitened) for r in far if r.component == 1)


def test_no_spread_and_empty(spark):
    one = whiten(frame(spark, [(1, [1.0, 2.0], 0, "", "")]), work_dir(spark, "t")).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    flat = whiten(frame(spark, [(k, [float(k), 3.0], 0, "", "") for k in (1, 2, None)[:2]] + [(None, [4.0, 3.0], 0, "", "")]), work_dir(spark, "t")).collect()
    assert len(flat) == 6 and {r.whitened is None for r in flat if r.component == 2} == {True} and {r.explained for r in flat if r.component == 2} == {0.0}
    assert whiten(frame(spark, []), work_dir(spark, "t")).count() == 0


def test_residues():
    moduli = enough_primes(10**30)
    assert math.prod(moduli) > 2 * 10**30 and all(p < 1 << whitening.PRIME_BITS for p in moduli)
    for x in (0, 1, -1, 10**30, -(10**30), 123456789012345678901234567):
        assert from_residues([x % p for p in moduli], moduli) == x
