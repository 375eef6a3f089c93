"""The best rotation of one set of points onto another, as columns.

From the sums of products of both sets' centred coordinates (covariances, which Spark adds up in a stable way) follows a
symmetric 4 by 4 matrix whose eigenvector of the largest eigenvalue is the rotation, as a quaternion. The
eigenvalue is the largest root of a polynomial of degree four without a cubic term, found by Newton steps from
above; the eigenvector is a column of the adjugate, improved once by its own Rayleigh quotient. Every step is a layer of columns, so that nothing
is written out twice.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Newton steps; the polynomial is convex above its largest root, so they come down to it, and halve their distance at worst.
STEPS = 60
_PAIRS = list(combinations_with_replacement(range(3), 2))
_c = F.col


def moments() -> list[Column]:
    """Aggregates of columns _x0 .. _y2: means, covariances of y with x, and of each with itself."""
    means = [F.avg(f"_{p}{k}").alias(f"_m{p}{k}") for p in "xy" for k in range(3)]
    mixed = [F.covar_pop(f"_y{i}", f"_x{j}").alias(f"_s{i}{j}") for i in range(3) for j in range(3)]
    return means + mixed + [F.covar_pop(f"_{p}{i}", f"_{p}{j}").alias(f"_{p}{p}{i}{j}") for p in "xy" for i, j in _PAIRS]


def _det3(m: list[list[Column]]) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def _adjugate(m: list[list[Column]]) -> dict[tuple[int, int], Column]:
    """The adjugate of a symmetric 4 by 4 matrix, i <= j."""
    minor = lambda i, j: [[m[r][c] for c in range(4) if c != j] for r in range(4) if r != i]
    return {(i, j): _det3(minor(i, j)) * (-1) ** (i + j) for i in range(4) for j in range(i, 4)}


def _matrix(name: str, less: str | None = None) -> list[list[Column]]:
    """The symmetric matrix of columns name + ij, less a column on its diagonal."""
    at = lambda i, j: _c(f"{name}{min(i, j)}{max(i, j)}")
    return [[at(i, j) - _c(less) if less and i == j else at(i, j) for j in range(4)] for i in range(4)]


def _unit(values: list[Column], otherwise: list[Column]) -> list[Column]:
    size = F.sqrt(sum((v * v for v in values), F.lit(0.0)))
    return [F.coalesce(F.try_divide(v, size), o) for v, o in zip(values, otherwise)]


def turns(sums: DataFrame) -> DataFrame:
    """sums (a row per alignment, with moments()) with the rotation _r00 .. _r22 of y onto x, and _ux0 .. _uy2, the line that points on one line lie on (null for a single place)."""
    scale = sum((_c(f"_{p}{p}{k}{k}") for p in "xy" for k in range(3)), F.lit(0.0)) / 2
    rows = sums.withColumn("_scale", F.nullif(scale, F.lit(0.0)))
    rows = rows.withColumns({f"_s{i}{j}": _c(f"_s{i}{j}") / _c("_scale") for i in range(3) for j in range(3)})
    s = [[_c(f"_s{i}{j}") for j in range(3)] for i in range(3)]
    k = {
        "00": s[0][0] + s[1][1] + s[2][2], "01": s[1][2] - s[2][1], "02": s[2][0] - s[0][2], "03": s[0][1] - s[1][0], "11": s[0][0] - s[1][1] - s[2][2],
        "12": s[0][1] + s[1][0], "13": s[2][0] + s[0][2], "22": s[1][1] - s[0][0] - s[2][2], "23": s[1][2] + s[2][1], "33": s[2][2] - s[0][0] - s[1][1],
    }
    squares = sum((x * x for row in s for x in row), F.lit(0.0))
    rows = rows.withColumns({**{f"_k{ij}": v for ij, v in k.items()}, "_c2": -2 * squares, "_c1": -8 * _det3(s)})
    m = _matrix("_k")
    cofactors = _adjugate(m)
    rows = rows.withColumn("_c0", sum((m[0][j] * cofactors[0, j] for j in range(4)), F.lit(0.0)))

    def step(x: Column, _: Column) -> Column:
        slope = (4 * x * x + 2 * _c("_c2")) * x + _c("_c1")
        return F.when(slope > 0, x - (((x * x + _c("_c2")) * x + _c("_c1")) * x + _c("_c0")) / slope).otherwise(x)

    rows = rows.withColumn("_root", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(1.0), step))
    # Of the adjugate's columns, all along the eigenvector, the longest.
    rows = rows.withColumns({f"_a{i}{j}": v for (i, j), v in _adjugate(_matrix("_k", "_root")).items()})
    a = _matrix("_a")
    best = F.greatest(*(F.struct(sum((a[i][j] * a[i][j] for i in range(4)), F.lit(0.0)).alias("size"), F.array(*(a[i][j] for i in range(4))).alias("v")) for j in range(4)))
    rows = rows.withColumn("_best", best["v"])
    for i, v in enumerate(_unit([F.get("_best", F.lit(i)) for i in range(4)], [F.lit(float(i == 0)) for i in range(4)])):
        rows = rows.withColumn(f"_p{i}", v)
    q = [_c(f"_p{i}") for i in range(4)]
    rows = rows.withColumn("_root", sum((q[i] * m[i][j] * q[j] for i in range(4) for j in range(4)), F.lit(0.0)))
    rows = rows.withColumns({f"_a{i}{j}": v for (i, j), v in _adjugate(_matrix("_k", "_root")).items()})
    rows = rows.withColumns({f"_q{i}": sum((a[i][j] * q[j] for j in range(4)), F.lit(0.0)) for i in range(4)})
    rows = rows.withColumns({f"_q{i}": v for i, v in enumerate(_unit([_c(f"_q{i}") for i in range(4)], q))})
    w, x, y, z = (_c(f"_q{i}") for i in range(4))
    r = {
        "00": w * w + x * x - y * y - z * z, "01": 2 * (x * y - w * z), "02": 2 * (x * z + w * y), "10": 2 * (x * y + w * z), "11": w * w - x * x + y * y - z * z,
        "12": 2 * (y * z - w * x), "20": 2 * (x * z - w * y), "21": 2 * (y * z + w * x), "22": w * w - x * x - y * y + z * z,
    }
    rows = rows.withColumns({f"_r{ij}": v for ij, v in r.items()})
    lines = {f"_u{p}{k}": v for p in "xy" for k, v in enumerate(_line(p))}
    return rows.withColumns(lines).select(*(c for c in sums.columns if not c.startswith(("_s", "_xx", "_yy"))), *(f"_r{ij}" for ij in r), *lines)


def _line(p: str) -> list[Column]:
    """The unit vector along the longest column of a set's covariances."""
    at = lambda i, j: _c(f"_{p}{p}{min(i, j)}{max(i, j)}")
    longest = F.greatest(*(F.struct(at(k, k).alias("size"), F.array(*(at(k, j) for j in range(3))).alias("v")) for k in range(3)))["v"]
    parts = [F.get(longest, F.lit(k)) for k in range(3)]
    return _unit(parts, [F.lit(None).cast("double")] * 3)


def _centred(p: str) -> list[Column]:
    return [_c(f"_{p}{k}") - _c(f"_m{p}{k}") for k in range(3)]


def beside(p: str) -> Column:
    """The square of a point's distance from its set's line."""
    v, u = _centred(p), [_c(f"_u{p}{k}") for k in range(3)]
    along = sum((a * b for a, b in zip(v, u)), F.lit(0.0))
    return sum(((a - along * b) * (a - along * b) for a, b in zip(v, u)), F.lit(0.0))


def distance() -> Column:
    """The distance of x and the rotated y."""
    x, y = _centred("x"), _centred("y")
    apart = [sum((_c(f"_r{i}{j}") * y[j] for j in range(3)), F.lit(0.0)) - x[i] for i in range(3)]
    return F.sqrt(sum((d * d for d in apart), F.lit(0.0)))
