"""Poses as column expressions: rotations between their forms, rigid transforms, channels of two arms.

Quaternions here are (x, y, z, w) arrays, rotations in matrix form nine numbers row by row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions import scalar


def scalar_first(q: Column) -> Column:
    return F.array(q[3], q[0], q[1], q[2])


def scalar_last(q: Column) -> Column:
    return F.array(q[1], q[2], q[3], q[0])


def unit(q: Column) -> Column:
    """The quaternion brought to length one; null if it is all but zero."""
    size = scalar.norm(q)
    return F.when(size >= 1e-8, F.transform(q, lambda v: v / size))


def multiply(a: Column, b: Column) -> Column:
    return scalar.bound(scalar_last, scalar.quaternion_multiply(scalar.bound(scalar_first, a), scalar.bound(scalar_first, b)))


def conjugate(q: Column) -> Column:
    """The inverse of a unit quaternion."""
    return F.array(-q[0], -q[1], -q[2], q[3])


def rotate(q: Column, p: Column) -> Column:
    """A point turned by a unit quaternion: p + 2 w (v x p) + 2 v x (v x p)."""

    def cross(a: Column, b: Column) -> Column:
        return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])

    def turned(q: Column, p: Column, once: Column) -> Column:
        twice = cross(q, once)
        return F.array(*(p[i] + (q[3] * once[i] + twice[i]) * 2 for i in range(3)))

    return scalar.bound(lambda q, p: scalar.bound(turned, q, p, cross(q, p)), q, p)


def from_matrix(m: Column, tolerance: float = 1e-4) -> Column:
    """The quaternion of a rotation matrix with w >= 0; null if the matrix is no rotation within the tolerance.

    Of w, x, y, z the one with the largest square is taken from the diagonal,
    the others from sums and differences across it.
    """
    a, b, c, d, e, f, g, h, i = (m[k] for k in range(9))
    squares = [(a - e - i + 1) / 4, (e - a - i + 1) / 4, (i - a - e + 1) / 4, (a + e + i + 1) / 4]
    pairs = {(0, 1): b + d, (0, 2): c + g, (1, 2): f + h, (0, 3): h - f, (1, 3): c - g, (2, 3): d - b}

    def through(k: int) -> Column:
        root = F.sqrt(squares[k])
        return F.array(*(root if j == k else pairs[min(j, k), max(j, k)] / (root * 4) for j in range(4)))

    largest = F.greatest(*squares)
    found = F.when(squares[3] == largest, through(3)).when(squares[0] == largest, through(0)).when(squares[1] == largest, through(1)).otherwise(through(2))
    signed = F.when(found[3] < 0, F.transform(found, lambda v: -v)).otherwise(found)
    return F.when((scalar.orthonormal_error(m) <= tolerance) & (F.abs(scalar.determinant(m) - 1) <= tolerance), unit(signed))


def transform(source: Column, target: Column, shift: Column, turn: Column, confidence: Column) -> Column:
    """A rigid transform from one named frame to another."""
    return F.struct(source.alias("source"), target.alias("target"), shift.alias("shift"), turn.alias("turn"), confidence.alias("confidence"))


def compose(left: Column, right: Column) -> Column:
    """First ``right``, then ``left``; null unless the frame between them is the same."""

    def both(left: Column, right: Column) -> Column:
        moved = F.zip_with(left["shift"], rotate(left["turn"], right["shift"]), lambda x, y: x + y)
        found = transform(right["source"], left["target"], moved, multiply(left["turn"], right["turn"]), F.least(left["confidence"], right["confidence"]))
        return F.when(left["source"] == right["target"], found)

    return scalar.bound(both, left, right)


def inverse(t: Column) -> Column:
    def turned(t: Column, back: Column) -> Column:
        return transform(t["target"], t["source"], F.transform(rotate(back, t["shift"]), lambda v: -v), back, t["confidence"])

    return scalar.bound(lambda t: scalar.bound(turned, t, conjugate(t["turn"])), t)


def apply(t: Column, point: Column) -> Column:
    return scalar.bound(lambda t, point: F.zip_with(t["shift"], rotate(t["turn"], point), lambda x, y: x + y), t, point)


def two_arms(values: Column, slack: float = 1e-6) -> Column:
    """14 channels of 16: position, roll, pitch, yaw and gripper of each arm; null if a gripper lies outside 0 to 1 by more than the slack or a quaternion is zero."""
    out, good = [], F.lit(True)
    for k in (0, 8):
        turn = F.slice(values, k + 4, 4)
        angles = scalar.euler_from_quaternion(scalar_first(turn))
        grip = values[k + 7]
        good = good & (grip >= -slack) & (grip <= 1 + slack) & (scalar.norm(turn) >= 1e-8)
        out += [*(values[k + i] for i in range(3)), *(angles[i] for i in range(3)), scalar.clamp(grip, 0.0, 1.0)]
    return F.when(good, F.array(*out))


def is_semidefinite(m: Column, tolerance: float = 1e-10, asymmetry: float = 1e-8) -> Column:
    """Whether a symmetric 3 x 3 matrix (row by row) has no eigenvalue below -``tolerance``.

    That is so if the matrix with the tolerance added to its diagonal has a
    Cholesky decomposition, whose pivots are of the size of the matrix itself,
    however small that is. Null or non-finite entries and opposite entries that
    differ by more than ``asymmetry`` give false.
    """
    a, b, c, _, e, f, _, _, i = (m[k].cast("double") for k in range(9))
    finite = F.forall(m, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    symmetric = F.greatest(F.abs(m[1] - m[3]), F.abs(m[2] - m[6]), F.abs(m[5] - m[7])) <= asymmetry
    first = a + tolerance
    second = e + tolerance - F.try_divide(b * b, first)
    rest = f - F.try_divide(b * c, first)
    third = i + tolerance - F.try_divide(c * c, first) - F.try_divide(rest * rest, second)
    return F.coalesce((F.size(m) == 9) & finite & symmetric & (first > 0) & (second > 0) & (third > 0), F.lit(False))
