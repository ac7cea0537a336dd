"""Positions and quaternions (x, y, z, w) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Vector = list[Column]


def dot(a: Vector, b: Vector) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        out = out + x * y
    return out


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def euclid(a: Vector, b: Vector) -> Column:
    return norm([x - y for x, y in zip(a, b)])


def lerp(a: Vector, b: Vector, t: Column) -> Vector:
    return [x + (y - x) * t for x, y in zip(a, b)]


def unit(q: Vector) -> Vector:
    """Normalised; null for a zero quaternion."""
    n = norm(q)
    return [F.try_divide(x, n) for x in q]


def slerp_weights(a: Vector, b: Vector, t: Column) -> Vector:
    """What a and b weigh in the shortest-path interpolation of unit quaternions, before it is normalised; nearly parallel ones (over 0.9995) weigh linearly."""
    d = dot(a, b)
    sign, c = F.when(d < 0, -1.0).otherwise(1.0), F.least(F.abs(d), F.lit(1.0))
    angle = F.acos(c)
    near = c > 0.9995
    return [F.when(near, 1 - t).otherwise(F.try_divide(F.sin((1 - t) * angle), F.sin(angle))), sign * F.when(near, t).otherwise(F.try_divide(F.sin(t * angle), F.sin(angle)))]


def slerp(a: Vector, b: Vector, t: Column) -> Vector:
    """Shortest-path spherical interpolation of unit quaternions; see slerp_weights."""
    wa, wb = slerp_weights(a, b, t)
    return unit([wa * x + wb * y for x, y in zip(a, b)])


def conjugate(q: Vector) -> Vector:
    return [-q[0], -q[1], -q[2], q[3]]


def multiply(a: Vector, b: Vector) -> Vector:
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return [
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    ]


def rotate(q: Vector, v: Vector) -> Vector:
    """v turned by the unit quaternion q."""
    p = multiply(multiply(q, [*v, F.lit(0.0)]), conjugate(q))
    return p[:3]


def rotation_angle(q: Vector) -> Column:
    """Radians of a unit quaternion's turn, 0 to pi."""
    return 2 * F.atan2(norm(q[:3]), F.abs(q[3]))


def apply_rigid(matrix: list[list[float]], shift: list[float], v: Vector) -> Vector:
    """R v + t with literal R and t."""
    return [sum((F.lit(float(m)) * x for m, x in zip(row, v)), F.lit(float(t))) for row, t in zip(matrix, shift)]
