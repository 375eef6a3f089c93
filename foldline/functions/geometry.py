"""Three-dimensional geometry as columns. A vector is a triple of DOUBLE columns, so every
expression stays within generated code. A zero length gives null, never NaN or an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vector(name: str) -> Vector:
    """The components of a column array<double> of three."""
    return tuple(F.get(F.col(name), F.lit(k)) for k in range(3))


def packed(v: Vector) -> Column:
    """array<double>, or null if a component is null."""
    return F.when(v[0].isNotNull() & v[1].isNotNull() & v[2].isNotNull(), F.array(*v))


def add(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b))


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b))


def scale(a: Vector, s: Column | float) -> Vector:
    return tuple(x * s for x in a)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    size = norm(a)
    return tuple(F.try_divide(x, size) for x in a)


def distance2(a: Vector, b: Vector) -> Column:
    return dot(sub(a, b), sub(a, b))


def distance(a: Vector, b: Vector) -> Column:
    return F.sqrt(distance2(a, b))


#: Fixed value: distance of the approximated side-chain atom, in angstrom.
CB_LENGTH = 1.5336


def approx_cb(ca: Vector, n: Vector, c: Vector) -> Vector:
    """A side-chain atom placed tetrahedrally from the three backbone atoms."""
    v1, v2 = unit(sub(c, ca)), unit(sub(n, ca))
    b1 = add(v2, scale(v1, 1 / 3))
    b2 = cross(v1, b1)
    u1, u2 = unit(b1), unit(b2)
    side = add(scale(u1, -0.5), scale(u2, -math.sqrt(3) / 2))
    v4 = add(scale(v1, -1 / 3), scale(side, F.lit(math.sqrt(8) / 3) * norm(v1)))
    return add(ca, scale(v4, CB_LENGTH))


def rotate(v: Vector, axis: Vector, degrees: float) -> Vector:
    """v turned about a unit axis."""
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return add(add(scale(v, cos), scale(cross(axis, v), sin)), scale(axis, dot(axis, v) * (1 - cos)))


def virtual_center(ca: Vector, cb: Vector, n: Vector, alpha: float, beta: float, length: float) -> Vector:
    """CB turned by alpha about the normal of CB, CA, N, then by beta about CA-N, at `length` times its distance."""
    v = sub(cb, ca)
    k = cross(v, sub(n, ca))
    floor = F.greatest(norm(k), F.lit(1e-8))
    v = rotate(v, tuple(x / floor for x in k), alpha)
    v = rotate(v, unit(sub(n, ca)), beta)
    return add(ca, scale(v, length))


def scaled_cb(ca: Vector, cb: Vector, factor: float) -> Vector:
    return add(ca, scale(sub(cb, ca), factor))


def signed_log(delta: Column) -> Column:
    """sign(d) ln(|d| + 1)."""
    return F.signum(delta.cast("double")) * F.log1p(F.abs(delta).cast("double"))


def separation_of(f9: Column) -> Column:
    """The sequence separation that signed_log was taken of, without its sign."""
    return F.rint(F.exp(F.abs(f9)) - 1).cast("int")


def descriptor(before: Vector, at: Vector, after: Vector, p_before: Vector, p_at: Vector, p_after: Vector, delta: Column) -> list[Column]:
    """Ten features of a residue and its partner: seven cosines, distance, clipped and logarithmic separation."""
    u1, u2 = unit(sub(at, before)), unit(sub(after, at))
    u3, u4 = unit(sub(p_at, p_before)), unit(sub(p_after, p_at))
    u5 = unit(sub(p_at, at))
    cosines = [dot(a, b) for a, b in ((u1, u2), (u3, u4), (u1, u5), (u3, u5), (u1, u4), (u2, u3), (u1, u3))]
    return [*cosines, distance(at, p_at), F.greatest(F.lit(-4), F.least(F.lit(4), delta)).cast("double"), signed_log(delta)]
