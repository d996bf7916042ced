"""Quaternions (x, y, z, w) and poses in NumPy, for use in grouped Arrow functions."""

from __future__ import annotations

import numpy as np


def unit(q: np.ndarray) -> np.ndarray:
    return q / np.maximum(np.linalg.norm(q, axis=-1, keepdims=True), 1e-12)


def to_matrix(q: np.ndarray) -> np.ndarray:
    """Rotation matrices of unit quaternions, by v -> v + 2 w (u x v) + 2 u x (u x v)."""
    u, w = q[..., :3], q[..., 3, None, None]
    k = np.zeros((*q.shape[:-1], 3, 3))
    k[..., 0, 1], k[..., 0, 2], k[..., 1, 2] = -u[..., 2], u[..., 1], -u[..., 0]
    k -= np.swapaxes(k, -1, -2).copy()
    return np.eye(3) + 2 * w * k + 2 * k @ k


def from_matrix(r: np.ndarray) -> np.ndarray:
    """Unit quaternion with w >= 0: the dominant eigenvector of the matrix of Bar-Itzhack."""
    k = np.empty((*r.shape[:-2], 4, 4))
    for i in range(3):
        for j in range(3):
            k[..., i, j] = r[..., i, j] + r[..., j, i] if i != j else 2 * r[..., i, i] - np.trace(r, axis1=-2, axis2=-1)
    k[..., 3, 0] = k[..., 0, 3] = r[..., 2, 1] - r[..., 1, 2]
    k[..., 3, 1] = k[..., 1, 3] = r[..., 0, 2] - r[..., 2, 0]
    k[..., 3, 2] = k[..., 2, 3] = r[..., 1, 0] - r[..., 0, 1]
    k[..., 3, 3] = np.trace(r, axis1=-2, axis2=-1)
    q = np.linalg.eigh(k)[1][..., -1]
    return np.where(q[..., 3:] < 0, -q, q)


def from_axis_angle(a: np.ndarray) -> np.ndarray:
    t = np.linalg.norm(a, axis=-1, keepdims=True)
    return np.concatenate([a * np.sinc(t / (2 * np.pi)) / 2, np.cos(t / 2)], axis=-1)


def rpy(r: float, p: float, y: float) -> np.ndarray:
    """Rotation by roll about x, then pitch about y, then yaw about z."""
    axes = np.eye(3)
    a, b, c = (to_matrix(from_axis_angle(axes[i] * t)) for i, t in enumerate((r, p, y)))
    return c @ b @ a


def slerp(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """From a to b along the shorter arc; nearly equal ones are mixed linearly."""
    d = float(a @ b)
    b, d = (-b, -d) if d < 0 else (b, d)
    if d > 0.9995:
        return unit(a + t * (b - a))
    angle = np.arccos(d)
    return (np.sin((1 - t) * angle) * a + np.sin(t * angle) * b) / np.sin(angle)


def mean(qs: np.ndarray, running: bool = True) -> np.ndarray:
    """Normalised sum with signs fixed to the running sum, or to the first."""
    total = qs[0].copy()
    for q in qs[1:]:
        total += q if q @ (total if running else qs[0]) >= 0 else -q
    return unit(total)


def smoothed(qs: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Kernel mean of each quaternion's neighbours by slerp, one after the other from the left; weights past the ends are left out."""
    half, out = len(kernel) // 2, np.empty_like(qs)
    for i in range(len(qs)):
        lo, hi = max(0, i - half), min(len(qs), i + half + 1)
        w = kernel[lo - i + half : hi - i + half]
        acc, weight = qs[lo], w[0]
        for q, k in zip(qs[lo + 1 : hi], w[1:], strict=True):
            weight += k
            acc = slerp(acc, q, k / weight)
        out[i] = acc
    return out


def interpolated(frames: np.ndarray, q: np.ndarray, t: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Missing rotations by slerp and translations linearly between valid neighbours; ends copy the nearest; with none valid all stay as they are."""
    known = np.flatnonzero(valid)
    q, t = q.copy(), t.copy()
    if not len(known):
        return q, t
    for i in np.flatnonzero(~valid):
        k = np.searchsorted(known, i)
        if k in (0, len(known)):
            j = known[min(k, len(known) - 1)]
            q[i], t[i] = q[j], t[j]
        else:
            a, b = known[k - 1], known[k]
            s = (frames[i] - frames[a]) / (frames[b] - frames[a])
            q[i], t[i] = slerp(q[a], q[b], s), t[a] + s * (t[b] - t[a])
    return q, t


def sim3(src_q: np.ndarray, src_t: np.ndarray, ref_q: np.ndarray, ref_t: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Scale, rotation and translation that take poses of one window to those of another.

    Rotation: mean of the relative rotations. Scale: median ratio of pairwise distances, 1 outside
    [0.5, 2]. Translation: median of what is left.
    """
    r = to_matrix(mean(from_matrix(to_matrix(ref_q) @ np.swapaxes(to_matrix(src_q), -1, -2)), running=False))
    i, j = np.triu_indices(len(src_t), 1)
    a, b = np.linalg.norm(src_t[i] - src_t[j], axis=1), np.linalg.norm(ref_t[i] - ref_t[j], axis=1)
    ratio = b[a > 1e-9] / a[a > 1e-9]
    s = float(np.median(ratio)) if len(ratio) else 1.0
    s = s if 0.5 <= s <= 2.0 else 1.0
    return s, r, np.median(ref_t - s * src_t @ r.T, axis=0)


def up_vector(ups: np.ndarray) -> np.ndarray | None:
    """Common up direction of at least three vectors: signs fixed to the first, robust median, unit length."""
    if len(ups) < 3:
        return None
    return unit(robust_median(np.where((ups @ ups[0] < 0)[:, None], -ups, ups)))


def robust_median(x: np.ndarray) -> np.ndarray:
    """Median of the rows within some robust deviations of the median in every column."""
    m = np.median(x, axis=0)
    if len(x) < 5:
        return m
    sigma = np.maximum(1.4826 * np.median(np.abs(x - m), axis=0), 1e-8)
    keep = (np.abs(x - m) <= (4.0 if len(x) <= 6 else 3.5 if len(x) <= 9 else 3.0) * sigma).all(axis=1)
    return np.median(x[keep], axis=0) if keep.any() else m
