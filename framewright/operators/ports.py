"""Ports for models that the engine does not contain: detectors, trackers, captioners, solvers, renderers.

A port is a function on Arrow batches of one table, or on one window's rows, with a declared
result. `Stub` gives deterministic answers, so that whole flows run in tests.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Port:
    """name, result schema, and a function from a pandas frame to a pandas frame."""

    name: str
    schema: str
    run: Callable[[pd.DataFrame], pd.DataFrame]

    def rows(self, df: DataFrame) -> DataFrame:
        """Row by row, in batches."""

        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield self.run(b)

        return df.mapInPandas(go, self.schema)

    def groups(self, df: DataFrame, key: list[str]) -> DataFrame:
        """Window by window; a window's length bounds the rows at once."""
        return df.groupBy(*key).applyInPandas(lambda g: self.run(g), self.schema)

    def with_fallback(self, other: Port, df: DataFrame, key: list[str], value: str) -> DataFrame:
        """This port's value where it gives one, else the other's, and which one it was."""
        from pyspark.sql import functions as F

        a = self.groups(df, key).withColumnRenamed(value, "_a")
        b = other.groups(df, key).withColumnRenamed(value, "_b").select(*key, "_b")
        j = a.join(b, key, "full_outer")
        which = F.when(F.col("_a").isNotNull(), self.name).when(F.col("_b").isNotNull(), other.name)
        return j.withColumn(value, F.coalesce("_a", "_b")).withColumn("model", which).drop("_a", "_b")


@dataclass(frozen=True)
class Contract:
    """What a model outside the engine takes and gives: its unit of work, the columns it reads, its result."""

    unit: str
    takes: str
    gives: str

    def port(self, name: str, run: Callable[[pd.DataFrame], pd.DataFrame]) -> Port:
        return Port(name, self.gives, run)


_BOX = "x1 double, y1 double, x2 double, y2 double"
_POSE = "q array<double>, t array<double>"
#: Every model that the flows call, by name.
CONTRACTS = {
    "video_frames": Contract("clip", "clip_id string, path string", "clip_id string, frame_id int, height int, width int, image binary"),
    "video_header": Contract("clip", "clip_id string, path string", "clip_id string, height int, width int, fps double, frames long"),
    "video_sink": Contract("segment", "seg_name string, frame_id int, image binary", "seg_name string, path string, frames long, fps double"),
    "motion": Contract("frame", "clip_id string, frame_id int, image binary", "clip_id string, frame_id int, is_moving boolean, laplacian double"),
    "calibrator": Contract("window", "clip_id string, w_start int, image binary", "clip_id string, w_start int, fx double, fy double, cx double, cy double, xi double"),
    "hand_detector": Contract("frame", "clip_id string, frame_id int, image binary", f"clip_id string, frame_id int, hand_idx int, {_BOX}, conf double, side int, side_conf double"),
    "tracker": Contract("clip", f"clip_id string, frame_id int, hand_idx int, {_BOX}, conf double", "clip_id string, frame_id int, hand_idx int, track int"),
    "hand_mesh": Contract("window", f"clip_id string, w_start int, frame_id int, hand_idx int, {_BOX}, image binary", "clip_id string, w_start int, frame_id int, hand_idx int, kpts3d array<array<double>>, wrist_rot array<double>, finger_rot array<array<double>>, hand_mask binary"),
    "slam": Contract("window", "clip_id string, w_start int, frame_id int, image binary", f"clip_id string, w_start int, frame_id int, {_POSE}"),
    "metric_depth": Contract("frame", "clip_id string, frame_id int, image binary", "clip_id string, frame_id int, scale double"),
    "gravity": Contract("frame", "clip_id string, frame_id int, image binary", "clip_id string, frame_id int, pitch double, roll double, up array<double>"),
    "person_detector": Contract("frame", "clip_id string, frame_id int, image binary", f"clip_id string, frame_id int, person int, {_BOX}, conf double"),
    "caption": Contract("window", "clip_id string, w_start int, w_end int, sample int", "clip_id string, w_start int, w_end int, sample int, answer string"),
    "text_gate": Contract("window", "clip_id string, w_start int, w_end int, sample int, left string, right string, bimanual string", "clip_id string, w_start int, w_end int, sample int, answer string"),
    "visual_gate": Contract("window", "clip_id string, w_start int, w_end int, sample int, left string, right string, bimanual string", "clip_id string, w_start int, w_end int, sample int, answer string"),
    "segmenter": Contract("window", "clip_id string, w_start int, frame_id int, image binary", "clip_id string, w_start int, frame_id int, arm_mask binary"),
    "inpainter": Contract("window", "clip_id string, w_start int, frame_id int, image binary, arm_mask binary", "clip_id string, w_start int, frame_id int, image binary"),
    "solver": Contract("segment", "seg_name string, frame_id int, targets array<double>", "seg_name string, frame_id int, joints array<double>, cost double"),
    "kinematics": Contract("segment", "seg_name string, frame_id int, joints array<double>", f"seg_name string, frame_id int, link string, {_POSE}"),
    "renderer": Contract("segment", f"seg_name string, frame_id int, joints array<double>, {_POSE}", "seg_name string, frame_id int, image binary, semantic binary"),
    "undistortion_maps": Contract("clip", "clip_id string, fx double, fy double, cx double, cy double, xi double, height int, width int", "clip_id string, map_x binary, map_y binary, scale double"),
    "compositor": Contract("frame", "seg_name string, frame_id int, image binary, overlay binary, semantic binary", "seg_name string, frame_id int, image binary"),
}


def blank(contract: Contract) -> Port:
    """A port that keeps the columns it knows and leaves the rest of its result null."""
    names = [f.split(" ")[0] for f in re.findall(r"\w+ (?:array<[^ ]+>|\w+)", contract.gives)]
    return contract.port("blank", lambda b: pd.DataFrame({n: b[n] if n in b else pd.Series([None] * len(b), dtype=object) for n in names}))


def _hash(*x) -> int:
    return zlib.crc32(repr(x).encode())


def caption_stub(verbs: tuple[str, ...] = ("pick", "place", "open"), things: tuple[str, ...] = ("jar", "lid", "knife")) -> Port:
    """One JSON answer for each (clip, window, sample)."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        def say(r) -> str:
            h = _hash(r.clip_id, r.w_start, r.sample // 2)
            left = f"{verbs[h % len(verbs)]} the {things[h // 7 % len(things)]}"
            return json.dumps({"think": "", "left": left if h % 5 else "n/a", "right": f"{verbs[h // 3 % len(verbs)]} the {things[h // 11 % len(things)]}", "bimanual": "n/a"})

        return pd.DataFrame({"clip_id": b.clip_id, "w_start": b.w_start, "w_end": b.w_end, "sample": b["sample"], "answer": [say(r) for r in b.itertuples()]})

    return Port("stub_caption", "clip_id long, w_start int, w_end int, sample int, answer string", run)


def detect_stub(per_frame: int = 2) -> Port:
    """Boxes for frames by a hash."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in b.itertuples():
            for k in range(per_frame):
                h = _hash(r.clip_id, r.frame_id, k)
                out.append((r.clip_id, r.frame_id, k, h % 2, h % 1000 / 1000, h % 400, h // 7 % 300, h % 400 + 50, h // 7 % 300 + 40))
        return pd.DataFrame(out, columns=["clip_id", "frame_id", "hand_idx", "side", "conf", "x1", "y1", "x2", "y2"]).astype({"x1": float, "y1": float, "x2": float, "y2": float})

    return Port("stub_detect", "clip_id long, frame_id int, hand_idx int, side int, conf double, x1 double, y1 double, x2 double, y2 double", run)
