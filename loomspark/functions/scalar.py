"""Numeric, angle, vector and text expressions on columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TAU = 2 * math.pi


def wrap_angle(x: Column) -> Column:
    """An angle brought into [-pi, pi)."""
    shifted = x + F.lit(math.pi)
    return shifted - F.lit(TAU) * F.floor(shifted / F.lit(TAU)) - F.lit(math.pi)


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.least(F.greatest(x, low), high)


def rounded(x: Column, places: int) -> Column:
    """A double rounded half away from zero as SQL does it, by its product with a power of ten; what is negative stays so, -0.0 too.

    Spark's ``round`` goes by decimal digits and has no negative zero.
    """
    size = F.abs(x) * F.lit(10.0**places)
    return F.when(size < float("inf"), F.signum(x) * (F.round(size) / F.lit(10.0**places))).otherwise(x)


def clamp_vector(values: Column, lows: Column, highs: Column) -> Column:
    """Element by element; all three arrays have one length."""
    floored = F.zip_with(values, lows, lambda v, lo: F.greatest(v, lo))
    return F.zip_with(floored, highs, lambda v, hi: F.least(v, hi))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return norm(gaps)


def cosine_score(a: Column, b: Column) -> Column:
    """Cosine in [0, 1]: two zero vectors are equal, a zero and another are not alike at all."""
    left, right = norm(a), norm(b)
    return (
        F.when((left == 0) & (right == 0), F.lit(1.0))
        .when((left == 0) | (right == 0), F.lit(0.0))
        .otherwise(clamp(dot(a, b) / (left * right), 0.0, 1.0))
    )


def half_even(x: Column) -> Column:
    """Rounds to the nearest whole number, halves to even ones."""
    return F.rint(x)


def smoothstep(x: Column) -> Column:
    t = clamp(x, 0.0, 1.0)
    return t * t * (F.lit(3.0) - F.lit(2.0) * t)


def smootherstep(x: Column) -> Column:
    t = clamp(x, 0.0, 1.0)
    return t * t * t * (t * (t * 6.0 - 15.0) + 10.0)


def decay_score(value: Column, reference: Column, rate: float) -> Column:
    """1 up to the reference, then falling exponentially."""
    return F.exp(F.lit(-rate) * F.greatest(F.lit(0.0), value - reference))


def ramp_weight(at: Column, start: Column, end: Column, ramp: Column | float) -> Column:
    """Weight of a place in a closed interval: 1 inside, falling linearly over ``ramp`` places at both ends, 0 outside."""
    ramp = ramp if isinstance(ramp, Column) else F.lit(float(ramp))
    up, down = (at - start + 1) / (ramp + 1), (end - at + 1) / (ramp + 1)
    return F.when((at < start) | (at > end), F.lit(0.0)).otherwise(F.least(F.lit(1.0), up, down))


def trapezoid_weight(at: Column, start: Column, end: Column, ramp: float) -> Column:
    """Like :func:`ramp_weight`, but 0 at both ends themselves."""
    return F.when((at < start) | (at > end), F.lit(0.0)).otherwise(F.least(F.lit(1.0), (at - start) / ramp, (end - at) / ramp))


def raised_cosine(at: Column, start: Column, length: Column | int) -> Column:
    """A fade from 0 to 1 over ``length`` places; two that meet add up to 1."""
    length = length if isinstance(length, Column) else F.lit(float(length))
    return F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(math.pi) * clamp((at - start + F.lit(0.5)) / length, 0.0, 1.0))


def one_hot(value: Column, domain: Sequence[str]) -> Column:
    return F.array(*(F.when(value == v, F.lit(1.0)).otherwise(F.lit(0.0)) for v in domain))


def with_interactions(context: Column, choice: Column) -> Column:
    """Context, choice and every product of the two, context first."""
    products = F.flatten(F.transform(context, lambda c: F.transform(choice, lambda r: c * r)))
    return F.concat(context, choice, products)


def bin_index(value: Column, low: Column | float, high: Column | float, bins: int) -> Column:
    """The equal-width bin of a value that is first clipped into the range."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    share = (clamp(value, low, high) - low) / (high - low)
    return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")


def hash_unit(key: Column) -> Column:
    """A number in [0, 1): the first 8 bytes of the key's SHA-256."""
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_word(values: Column, bits: int = 63) -> Column:
    """The signs of the first components as the bits of a whole number, the first the highest."""
    signs = F.transform(F.slice(values, 1, bits), lambda x: F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.aggregate(signs, F.lit(0).cast("long"), lambda word, bit: word * 2 + bit)


def bit_iou(a: Column, b: Column) -> Column:
    """Share of common set bits; two empty masks are equal."""
    either = F.bit_count(a.bitwiseOR(b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.bit_count(a.bitwiseAND(b)) / either)


def squeeze_space(text: Column) -> Column:
    """Words with single spaces between."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def safe_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"), F.lit(False))


def lerp(x0: Column, y0: Column, x1: Column, y1: Column, x: Column) -> Column:
    return F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def bound(f: Callable[..., Column], *columns: Column) -> Column:
    """``f`` of columns that are computed once, however often ``f`` names them, so that nested calls don't multiply the plan."""
    row = F.struct(*(c.alias(f"x{i}") for i, c in enumerate(columns)))
    return F.get(F.transform(F.array(row), lambda r: f(*(r[f"x{i}"] for i in range(len(columns))))), F.lit(0))


def quaternion_multiply(a: Column, b: Column) -> Column:
    """Hamilton product of (w, x, y, z) arrays, brought to length one."""

    def product(a: Column, b: Column) -> Column:
        w1, x1, y1, z1 = (a[i] for i in range(4))
        w2, x2, y2, z2 = (b[i] for i in range(4))
        return F.array(
            w1 * w2 - x1 * x2 - y1 * y2 - z1 * z2,
            w1 * x2 + x1 * w2 + y1 * z2 - z1 * y2,
            w1 * y2 - x1 * z2 + y1 * w2 + z1 * x2,
            w1 * z2 + x1 * y2 - y1 * x2 + z1 * w2,
        )

    return bound(lambda out: F.transform(out, lambda v: v / norm(out)), bound(product, a, b))


def quaternion_inverse(q: Column) -> Column:
    return bound(lambda q: bound(lambda size: F.array(q[0] / size, -q[1] / size, -q[2] / size, -q[3] / size), dot(q, q)), q)


def slerp(a: Column, b: Column, t: Column) -> Column:
    """Between two unit quaternions along the shorter arc; nearly equal ones are mixed linearly and brought to length one."""
    cosine = dot(a, b)
    near = F.when(cosine < 0, F.transform(b, lambda v: -v)).otherwise(b)
    cosine = F.abs(cosine)
    angle = F.acos(F.least(cosine, F.lit(1.0)))
    wa = F.when(cosine > 0.9995, F.lit(1.0) - t).otherwise(F.sin((F.lit(1.0) - t) * angle) / F.sin(angle))
    wb = F.when(cosine > 0.9995, t).otherwise(F.sin(t * angle) / F.sin(angle))
    out = F.zip_with(F.transform(a, lambda v: v * wa), F.transform(near, lambda v: v * wb), lambda x, y: x + y)
    return F.transform(out, lambda v: v / norm(out))


def rotation_angle(a: Column, b: Column) -> Column:
    """The angle between two rotations, given as unit quaternions; 0 where they are all but equal."""
    cosine = F.least(F.abs(dot(a, b)), F.lit(1.0))
    return F.when(cosine > 1 - 1e-12, F.lit(0.0)).otherwise(F.lit(2.0) * F.acos(cosine))


def euler_from_quaternion(q: Column) -> Column:
    """Roll, pitch and yaw of a (w, x, y, z) quaternion of any length but zero."""
    size = norm(q)
    w, x, y, z = (q[i] / size for i in range(4))
    return F.array(
        F.atan2((w * x + y * z) * 2, F.lit(1.0) - (x * x + y * y) * 2),
        F.asin(clamp((w * y - z * x) * 2, -1.0, 1.0)),
        F.atan2((w * z + x * y) * 2, F.lit(1.0) - (y * y + z * z) * 2),
    )


def boxes_overlap(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Whether two boxes share an area; edges that touch don't."""
    return (ax < bx + bw) & (bx < ax + aw) & (ay < by + bh) & (by < ay + ah)


def intervals_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two half-open intervals share a place."""
    return F.greatest(a_start, b_start) < F.least(a_end, b_end)


def strength_of_progress(progress: Column, cuts: Sequence[float], names: Sequence[str]) -> Column:
    """The name of the first cut that the progress is below, the last name beyond all."""
    out = F.when(progress < cuts[0], F.lit(names[0]))
    for cut, name in zip(cuts[1:], names[1:], strict=False):
        out = out.when(progress < cut, F.lit(name))
    return out.otherwise(F.lit(names[len(cuts)]))


def matrix_from_euler(roll: Column, pitch: Column, yaw: Column) -> Column:
    """The rotation about x, then y, then z as nine numbers, row by row."""
    cr, sr, cp, sp, cy, sy = F.cos(roll), F.sin(roll), F.cos(pitch), F.sin(pitch), F.cos(yaw), F.sin(yaw)
    return F.array(
        cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr,
        sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr,
        -sp, cp * sr, cp * cr,
    )


def matrix_angle(a: Column, b: Column) -> Column:
    """The angle between two rotations given as nine numbers each; 0 where they are all but equal."""
    cosine = clamp((dot(a, b) - 1) / 2, -1.0, 1.0)
    return F.when(cosine > 1 - 1e-12, F.lit(0.0)).otherwise(F.acos(cosine))


def orthonormal_error(m: Column) -> Column:
    """The largest difference of a 3 x 3 matrix's product with its transpose from the identity."""
    rows = [F.slice(m, 1 + 3 * i, 3) for i in range(3)]
    return F.greatest(*(F.abs(dot(rows[i], rows[j]) - (1.0 if i == j else 0.0)) for i in range(3) for j in range(i, 3)))


def determinant(m: Column) -> Column:
    a, b, c, d, e, f, g, h, i = (m[k] for k in range(9))
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def project(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float) -> Column:
    """Pixel coordinates of a point in front of a pinhole camera, null behind it."""
    return F.when(z > 0, F.struct((x / z * fx + cx).alias("u"), (y / z * fy + cy).alias("v")))
