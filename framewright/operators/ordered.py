"""Operators whose order of steps is part of their meaning: grouped Arrow/pandas functions, a clip or run at a time.

A group is one run, window or frame, which the sessions and window lengths bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from framewright.functions import quaternions as Q


def _array(s: pd.Series, size: int) -> np.ndarray:
    return np.array([np.full(size, np.nan) if v is None else np.asarray(v, float)[:size] for v in s]).reshape(-1, size)


def smoothed_rotations(df: DataFrame, key: list[str], frame: str, q: str, kernel: list[float], least: int) -> DataFrame:
    """q smoothed within each group of at least `least` rows."""
    weights = np.asarray(kernel)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(frame)
        x = Q.unit(_array(g[q], 4))
        return g.assign(**{q: list(Q.smoothed(x, weights) if len(x) >= least else x)})

    return df.select(*key, frame, q).groupBy(*key).applyInPandas(run, df.select(*key, frame, q).schema)


def interpolated_poses(df: DataFrame, key: list[str], frame: str, q: str, t: str) -> DataFrame:
    """Null poses filled within each group."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(frame)
        valid = g[q].notna().to_numpy()
        if not valid.any():
            return g
        a, b = Q.interpolated(g[frame].to_numpy(float), Q.unit(np.nan_to_num(_array(g[q], 4))), np.nan_to_num(_array(g[t], 3)), valid)
        return g.assign(**{q: list(a), t: list(b)})

    cols = df.select(*key, frame, q, t)
    return cols.groupBy(*key).applyInPandas(run, cols.schema)


def mean_rotation(df: DataFrame, key: list[str], frame: str, q: str, running: bool) -> DataFrame:
    kind = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in key)

    def run(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        m = Q.mean(Q.unit(_array(g.sort_values(frame)[q], 4)), running)
        return pd.DataFrame([[*k, *m]], columns=[*key, "qx", "qy", "qz", "qw"])

    return df.select(*key, frame, q).groupBy(*key).applyInPandas(run, f"{kind}, qx double, qy double, qz double, qw double")


def aligned(df: DataFrame, key: list[str], frame: str) -> DataFrame:
    """Scale, rotation matrix and translation from (q, t) to (ref_q, ref_t) over each group's frames."""
    turn = [f"r{i}{j}" for i in range(3) for j in range(3)]
    kind = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in key)

    def run(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(frame)
        s, r, t = Q.sim3(Q.unit(_array(g["q"], 4)), _array(g["t"], 3), Q.unit(_array(g["ref_q"], 4)), _array(g["ref_t"], 3))
        return pd.DataFrame([[*k, s, *r.ravel(), *t]], columns=[*key, "scale", *turn, "tx", "ty", "tz"])

    return df.select(*key, frame, "q", "t", "ref_q", "ref_t").groupBy(*key).applyInPandas(run, f"{kind}, scale double, {', '.join(f'{c} double' for c in turn)}, tx double, ty double, tz double")


def up_vectors(df: DataFrame, key: list[str], frame: str, up: str) -> DataFrame:
    kind = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in key)

    def run(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        u = Q.up_vector(Q.unit(_array(g.sort_values(frame)[up], 3)))
        return pd.DataFrame([] if u is None else [[*k, *u]], columns=[*key, "ux", "uy", "uz"])

    return df.select(*key, frame, up).groupBy(*key).applyInPandas(run, f"{kind}, ux double, uy double, uz double")


def suppressed(df: DataFrame, key: list[str], box: tuple[str, str, str, str], score: str, tie: str, iou: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression within each frame: by falling score, a box stays unless one that stayed covers it."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([score, tie], ascending=[False, True])
        b = g[list(box)].to_numpy(float)
        area = np.maximum(b[:, 2] - b[:, 0], 0) * np.maximum(b[:, 3] - b[:, 1], 0)
        kept: list[int] = []
        for i in range(len(b)):
            k = b[kept]
            w = np.maximum(0, np.minimum(k[:, 2], b[i, 2]) - np.maximum(k[:, 0], b[i, 0]))
            h = np.maximum(0, np.minimum(k[:, 3], b[i, 3]) - np.maximum(k[:, 1], b[i, 1]))
            both = w * h
            if not (both > iou * np.maximum(area[kept] + area[i] - both, 1e-12)).any():
                kept.append(i)
        return g.iloc[kept]

    return df.groupBy(*key).applyInPandas(run, df.schema)


def winners(df: DataFrame, clip: list[str], least: int, width: float) -> DataFrame:
    """clip, track, won: tracks (track, side, evidence, n, mean_x, frames) by falling evidence.

    A track loses if it has fewer than `least` frames, if its mean place lies in the other half of
    the image, or if it shares a frame with an earlier winner of its side.
    """
    kind = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in clip)

    def run(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        taken: dict[int, set] = {0: set(), 1: set()}
        out = []
        for r in g.sort_values(["evidence", "track"], ascending=[False, True]).itertuples():
            own = set(r.frames)
            won = r.n >= least and (r.mean_x >= width / 2) == bool(r.side) and not own & taken[r.side]
            if won:
                taken[r.side] |= own
            out.append((*k, r.track, won))
        return pd.DataFrame(out, columns=[*clip, "track", "won"])

    return df.groupBy(*clip).applyInPandas(run, f"{kind}, track int, won boolean")


def pair_direction_error(df: DataFrame, key: list[str], a: str, b: str, pairs: list[tuple[int, int]]) -> DataFrame:
    """Mean of 1 - cos between the directions of point pairs in two point sets (n x 3, flat)."""
    i, j = np.array(pairs).T

    def run(batches):
        for pdf in batches:
            out = []
            for x, y in zip(pdf[a], pdf[b], strict=True):
                x, y = np.asarray(x, float).reshape(-1, 3), np.asarray(y, float).reshape(-1, 3)
                u, v = Q.unit(x[j] - x[i]), Q.unit(y[j] - y[i])
                out.append(float(np.nanmean(1 - (u * v).sum(1))))
            yield pdf[key].assign(error=out)

    kind = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in key)
    return df.select(*key, a, b).mapInPandas(run, f"{kind}, error double")
