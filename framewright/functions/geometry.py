"""Geometry as column expressions: projection, rigid transforms, angles, sizes. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[Column]]


def at(a: Column, *i: int) -> Column:
    """Element of a nested array, from 0; null outside."""
    for k in i:
        a = F.get(a, k)
    return a


def matrix(flat: Column, n: int, m: int) -> Matrix:
    """A row-major array as a matrix of columns."""
    return [[F.get(flat, i * m + j) for j in range(m)] for i in range(n)]


def total(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out + x
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    return [[total([a[i][k] * b[k][j] for k in range(len(b))]) for j in range(len(b[0]))] for i in range(len(a))]


def transpose(a: Matrix) -> Matrix:
    return [list(r) for r in zip(*a, strict=True)]


def moved(r: Matrix, t: list[Column], p: list[Column]) -> list[Column]:
    """R p + t."""
    return [total([r[i][k] * p[k] for k in range(3)]) + t[i] for i in range(3)]


def inverse_se3(pose: Matrix) -> Matrix:
    """Inverse of a 4 x 4 rigid transform: transposed rotation, and minus that times the translation."""
    r = transpose([row[:3] for row in pose[:3]])
    t = [row[3] for row in pose[:3]]
    back = [-total([r[i][k] * t[k] for k in range(3)]) for i in range(3)]
    return [[*r[i], back[i]] for i in range(3)] + [[F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]]


def projected(p: list[Column], fx: Column, fy: Column, cx: Column, cy: Column) -> tuple[Column, Column]:
    """Pinhole image point; depth 0 counts as 1e-8."""
    z = F.when(p[2] == 0, F.lit(1e-8)).otherwise(p[2])
    return fx * p[0] / z + cx, fy * p[1] / z + cy


def xyz_rot6(pose: Matrix) -> list[Column]:
    """Translation, then the first two rows of the rotation."""
    return [pose[0][3], pose[1][3], pose[2][3], *pose[0][:3], *pose[1][:3]]


def rotation_angle(a: Matrix, b: Matrix) -> Column:
    """Degrees between two rotations."""
    trace = total([a[i][k] * b[i][k] for i in range(3) for k in range(3)])
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def roll(up: list[Column]) -> Column:
    """Degrees about the viewing axis, from the up vector in the camera."""
    return F.degrees(F.atan2(up[0], -up[1]))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def unit(a: list[Column]) -> list[Column]:
    n = F.sqrt(total([x * x for x in a])) + 1e-12
    return [x / n for x in a]


def gravity_basis(up: list[Column]) -> Matrix:
    """Rows of a right-handed basis whose third axis is `up`; the reference axis is x, or y where up is close to x."""
    z = unit(up)
    near = F.abs(z[0]) > 0.9
    ref = [F.when(near, 0.0).otherwise(1.0), F.when(near, 1.0).otherwise(0.0), F.lit(0.0)]
    along = total([a * b for a, b in zip(ref, z, strict=True)])
    x = unit([a - along * b for a, b in zip(ref, z, strict=True)])
    return [x, cross(z, x), z]


def yaw_moved(p: list[Column], t: list[Column], yaw: Column) -> list[Column]:
    """World point in a base that is shifted by t and turned by yaw about z."""
    d = [a - b for a, b in zip(p, t, strict=True)]
    c, s = F.cos(yaw), F.sin(yaw)
    return [c * d[0] + s * d[1], c * d[1] - s * d[0], d[2]]


def wrapped(deg: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(deg + 180, F.lit(360.0)) - 180


def output_size(h: Column, w: Column, short: int = 192) -> tuple[Column, Column]:
    """Height and width with the given short side; the long one rounded half to even, then up to an even number."""
    even = lambda n: (F.floor((n + 1) / 2) * 2).cast("int")
    long = lambda a, b: even(F.bround(a * short / b, 0))
    return F.when(h <= w, F.lit(short)).otherwise(long(h, w)), F.when(h <= w, long(w, h)).otherwise(F.lit(short))


def slam_size(h: Column, w: Column, area: int = 384 * 512, step: int = 8) -> tuple[Column, Column]:
    """Sides scaled to an area and cut to multiples of step."""
    s = F.sqrt(F.lit(float(area)) / (h * w))
    cut = lambda n: F.floor(n * s).cast("int") - F.floor(n * s).cast("int") % step
    return cut(h), cut(w)


def field_of_view(width: Column, f: Column) -> Column:
    return F.degrees(2 * F.atan(width / (2 * f)))


def aperture(f: Column, width: Column, focal_mm: float = 24.0) -> Column:
    """Horizontal aperture in mm of a camera with a given focal length in mm."""
    return focal_mm * width / f


def flipped_axes(pose: Matrix) -> Matrix:
    """OpenCV camera axes to OpenGL: y and z change sign."""
    return [[row[0], -row[1], -row[2], row[3]] for row in pose]


def wxyz(q: Column) -> Column:
    """Quaternion x, y, z, w to w, x, y, z."""
    return F.array(F.get(q, 3), F.get(q, 0), F.get(q, 1), F.get(q, 2))


def fitted(x: Column, width: int) -> Column:
    """Vector padded by zeros, or cut, to a width."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), width)), 1, width)


def in_image(points: Column, width: Column, height: Column) -> Column:
    """Whether all points (structs u, v) lie in the image."""
    return F.forall(points, lambda p: (p["u"] >= 0) & (p["u"] < width) & (p["v"] >= 0) & (p["v"] < height))


def kernel(size: int, sigma: float) -> Column:
    """Normalised Gaussian weights as an array column."""
    w = [math.exp(-0.5 * ((i - size // 2) / sigma) ** 2) for i in range(size)]
    return F.array(*[F.lit(x / sum(w)) for x in w])
