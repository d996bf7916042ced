"""Omnidirectional cameras: how far rectification moves the pixels, and whether it is needed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def moved(fx: float, fy: float, cx: float, cy: float, xi: float, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Source place (u, v) of each pixel of the rectified image: its ray on the unit sphere, seen from xi behind the centre."""
    v, u = np.mgrid[0:height, 0:width].astype(float)
    x, y = (u - cx) / fx, (v - cy) / fy
    depth = 1 + xi * np.sqrt(x * x + y * y + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return fx * x / depth + cx, fy * y / depth + cy


def displacement(fx: float, fy: float, cx: float, cy: float, xi: float, width: int, height: int, share: float = 99.0, border: float = 0.02) -> float | None:
    """Percentile of the distance by which pixels move, without a border; None if a place is not finite."""
    u, v = moved(fx, fy, cx, cy, xi, width, height)
    if not (np.isfinite(u).all() and np.isfinite(v).all()):
        return None
    b = round(max(width, height) * border)
    rows, cols = (slice(b, n - b if n > 2 * b else n) for n in (height, width))
    d = np.hypot(u - np.arange(width), v - np.arange(height)[:, None])
    return float(np.percentile(d[rows, cols], share))


@F.pandas_udf(DoubleType())
def displacement_p99(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    """displacement() of columns fx, fy, cx, cy, xi, width, height: one row a clip."""
    for rows in parts:
        yield pd.Series([None if any(x is None or x != x for x in r) else displacement(*r[:5], int(r[5]), int(r[6])) for r in zip(*rows, strict=True)], dtype="Float64")


def undistortion(xi: Column, p99: Column, limit: float = 0.5, flat: float = 1e-6, negative: float = 0.01) -> Column:
    """True: undistort; false: as it is; null: drop the clip."""
    return F.when(xi < 0, F.when(-xi > negative, F.lit(None).cast("boolean")).otherwise(False)).when(xi < flat, False).otherwise(p99 >= limit)


def level(pitch: Column, roll: Column, limit: float = math.radians(10)) -> Column:
    """Frames whose gravity can be trusted: looking down, hardly rolled (radians)."""
    return (pitch < 0) & (F.abs(roll) <= limit)
