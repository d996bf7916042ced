"""Order-dependent queries against plain NumPy, golden cases, and everything that touches files."""

import json
import zlib

import numpy as np
import pytest

from framewright.functions import camera
from framewright.functions import quaternions as Q
from framewright.operators import export as X
from framewright.operators import ports, sequences
from framewright.plans.catalogue import QUERIES
from framewright.sources import metadata, readers
from framewright.sources.adapters import detections
from framewright.streaming import sessions

SF = "/root/testdata/sf0.001"


def test_nms(spark):
    got = {r["event_id"] for r in QUERIES["nms"](spark, SF).collect()}
    frames: dict = {}
    for r in detections(spark, SF).filter("x2 > x1 and y2 > y1").collect():
        frames.setdefault((r["clip_id"], r["frame_id"] // 20), []).append(r)
    want = set()
    for rows in frames.values():
        left = sorted(rows, key=lambda r: (-r["conf"], r["event_id"]))
        while left:
            a, left = left[0], left[1:]
            want.add(a["event_id"])
            inter = lambda b: max(0, 150 - abs(a["x1"] - b["x1"])) * max(0, 150 - abs(a["y1"] - b["y1"]))  # noqa: E731, B023
            left = [b for b in left if inter(b) <= 0.3 * (2 * 150 * 150 - inter(b))]
    assert got == want


def test_mask_or(spark):
    want: dict = {}
    for r in detections(spark, SF).collect():
        bits = r["event_id"] * 2654435761 % 4294967296
        key = (r["clip_id"], r["frame_id"])
        want[key] = want.get(key, 0) | bits
    for r in QUERIES["mask_or"](spark, SF).collect():
        assert int(r["mask"][-16:], 16) == want[r["clip_id"], r["frame_id"]] and r["area"] == bin(int(r["mask"][-16:], 16)).count("1")


def test_hash_partition(spark):
    assert zlib.crc32(b"user_7") == 2320300117
    df = spark.createDataFrame([(f"user_{i}",) for i in range(200)], "k string")
    parts = [{r["k"] for r in readers.hash_part(df, "k", a, 4).collect()} for a in range(1, 5)]
    assert "user_7" in parts[1] and sum(map(len, parts)) == 200 and set.union(*parts) == {f"user_{i}" for i in range(200)}
    for a, b in ((0, 4), (5, 4)):
        with pytest.raises(ValueError):
            readers.check_part(a, b)


def test_quaternion_means_and_poses(spark):
    import pandas as pd

    e = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    for r in QUERIES["quat_mean"](spark, SF).collect():
        total = np.zeros(4)
        for v in e[e.label == r["clip_id"]].embedding:
            q = np.asarray(v[:4], float) / np.linalg.norm(np.asarray(v[:4], float))
            total += q if q @ total >= 0 else -q
        assert np.allclose([r["qx"], r["qy"], r["qz"], r["qw"]], total / np.linalg.norm(total))
    q, t = np.zeros((3, 4)), np.ones((3, 3))
    a, b = Q.interpolated(np.arange(3.0), q, t, np.zeros(3, bool))
    assert (a == q).all() and (b == t).all()
    rows = QUERIES["sim3_align"](spark, SF).collect()
    for r in rows:
        m = np.array([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)])
        assert np.allclose(m @ m.T, np.eye(3)) and 0.5 <= r["scale"] <= 2


def test_greedy_conflict(spark):
    for clip in {r["clip_id"] for r in QUERIES["greedy_conflict"](spark, SF).collect()}:
        rows = [r for r in QUERIES["greedy_conflict"](spark, SF).filter(f"clip_id = {clip}").collect()]
        assert len({r["track"] for r in rows}) == len(rows)
        break


def test_golden_speed_weights(spark):
    x = [0.0, 0.05, 0.10, 0.30, 0.35]
    df = spark.createDataFrame([(1, i, v, 0.0, 0.0, i != 9) for i, v in enumerate(x)], "c int, f int, x double, y double, z double, ok boolean")
    w = lambda d: [r["w"] for r in sequences.speed_weights(d, ["c"], "f", ["x", "y", "z"], 4.0, 30.0, "w", valid="ok").orderBy("f").collect()]
    assert np.allclose(w(df), [1, 0.980419, 0.201532, 0.01, 0.980419], atol=1e-6)
    assert w(df.selectExpr("c", "f", "x", "y", "z", "f <> 2 as ok"))[2] == 0


def test_rectification():
    assert camera.displacement(300, 300, 160, 120, 0.0, 320, 240) == pytest.approx(0)
    few, more = (camera.displacement(300, 300, 160, 120, xi, 320, 240) for xi in (0.001, 0.2))
    assert 0 < few < 0.5 < more
    u, v = camera.moved(300, 300, 160, 120, 0.2, 320, 240)
    ray = np.array([(310 - 160) / 300, (20 - 120) / 300, 1.0])
    ray /= np.linalg.norm(ray)
    assert u[20, 310] == pytest.approx(300 * ray[0] / (ray[2] + 0.2) + 160)


def test_undistortion_states(spark):
    rows = [(1, 300.0, 300.0, 160.0, 120.0, xi, 320, 240) for xi in (0.2, 0.0, -0.02, -0.005, 0.001)]
    df = spark.createDataFrame(rows, "c int, fx double, fy double, cx double, cy double, xi double, w int, h int")
    got = df.withColumn("p99", camera.displacement_p99("fx", "fy", "cx", "cy", "xi", "w", "h"))
    from pyspark.sql import functions as F

    assert [r["s"] for r in got.select(camera.undistortion(F.col("xi"), F.col("p99")).alias("s")).collect()] == [True, False, None, False, False]


def test_shards_and_markers(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for clip, n in (("a", 0), ("a", 1), ("a_1", 0), ("b", 0)):
        pq.write_table(pa.table({"frame_id": [n * 10 + i for i in range(3)], "x": [1.0, 2.0, 3.0], "y": [0, 0, 0]}), tmp_path / f"{clip}_{n}.parquet")
    for clip in ("a", "a_1"):
        (tmp_path / f"{clip}.done").write_bytes(b"")
    df = readers.shard_table(spark, str(tmp_path), ["x"])
    assert sorted((r["clip_id"], r["shard"], r["frame_id"]) for r in df.collect()) == sorted([("a", 0, i) for i in range(3)] + [("a", 1, 10 + i) for i in range(3)] + [("a_1", 0, i) for i in range(3)])
    assert "y" not in df.columns
    (tmp_path / "broken_0.parquet").write_bytes(b"no parquet at all")
    rows, lost = metadata.readable(spark, str(tmp_path))
    assert rows.count() == 12 and [r["file"] for r in lost.collect()] == ["broken_0.parquet"]


def test_clips_and_intrinsics(spark, tmp_path):
    for name in ("x.mp4", "y.MP4", "z.mp4"):
        (tmp_path / name).write_bytes(b"1")
    assert [r["clip_id"] for r in readers.clips(spark, str(tmp_path)).collect()] == ["x", "z"]
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "x.json").write_text('{"fx": 1.5, "fy": 2, "cx": 3, "cy": 4, "xi": 0, "H": 5, "W": 6, "model": "m"}')
    (tmp_path / "k" / "z.json").write_text("{}")
    got = readers.intrinsics(spark, str(tmp_path / "k")).collect()
    assert [(r["clip_id"], r["fx"], r["W"]) for r in got] == [("x", 1.5, 6)]


def test_sinks_replace_what_they_wrote(spark, tmp_path):
    path = str(tmp_path / "frames")
    rows = lambda clip, n: spark.createDataFrame([(clip, i) for i in range(n)], "clip_id string, frame_id int").coalesce(1)
    X.write_frames(rows("a", 12).union(rows("b", 3)), path, rows=5)
    X.write_frames(rows("a", 4), path, rows=5)
    got = spark.read.parquet(path).groupBy("clip_id").count().collect()
    assert {r["clip_id"]: r["count"] for r in got} == {"a": 4, "b": 3}
    assert metadata.footer(spark, path)[0] == 7 and set(metadata.footer(spark, path)[1]) == {"clip_id", "frame_id"}
    episodes = str(tmp_path / "episodes")
    X.write_episodes(spark.createDataFrame([(e, i) for e in (0, 999, 1000) for i in range(2)], "episode_index long, frame_index long"), episodes)
    assert sorted(p.name for p in (tmp_path / "episodes").iterdir() if p.is_dir()) == ["chunk=chunk-000", "chunk=chunk-001"]
    mark = str(tmp_path / "hash")
    X.check_fingerprint("abc", mark, spark)
    X.check_fingerprint("abc", mark, spark)
    with pytest.raises(ValueError):
        X.check_fingerprint("abd", mark, spark)


def test_metadata_round_trip(spark, tmp_path):
    root = str(tmp_path)
    doc = metadata.modality([("right_arm", 7), ("left_arm", 7), ("neck", 2)], "cam")
    metadata.write_document(spark, doc, root, "modality")
    info = metadata.info({"total_frames": 30, "total_episodes": 1001, "total_tasks": 2}, 30, "r", {"action": {"dtype": "float64", "shape": [16]}})
    metadata.write_document(spark, info, root, "info")
    metadata.write_document(spark, info, root, "info")  # a second write replaces the first
    assert metadata.document(spark, root, "info") == info and info["total_chunks"] == 2 and info["splits"] == {"train": "0:1001"}
    assert {(r["part"], r["name"]): (r["start"], r["end"]) for r in metadata.slices(spark, root).collect()}["action", "neck"] == (14, 16)
    assert metadata.document(spark, root, "none") == {}
    (tmp_path / "meta" / "tasks.jsonl").write_text('{"task_index": 0, "task": "open jar"}\n')
    (tmp_path / "meta" / "episodes.jsonl").write_text(json.dumps({"episode_index": 0, "tasks": ["open jar"], "length": 7, "clip_id": "a", "seg_name": "s"}) + "\n")
    assert metadata.tasks(spark, root).first()["task"] == "open jar" and metadata.episodes(spark, root).first()["length"] == 7


def test_batches_of_one_clip_are_all_kept(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k in range(2):
        (source / f"{k}.json").write_text("".join(json.dumps({"clip_id": 1, "frame_id": 10 * k + i}) + "\n" for i in range(4 + k)))
    stream = spark.readStream.schema("clip_id long, frame_id int").option("maxFilesPerTrigger", 1).json(str(source))
    sessions.once_per_batch(stream, out, str(tmp_path / "cp")).start().awaitTermination()
    assert spark.read.parquet(out).count() == 9


@pytest.mark.parametrize("name", sorted(ports.CONTRACTS))
def test_contracts(spark, name):
    c = ports.CONTRACTS[name]
    df = spark.createDataFrame([], c.takes)
    assert ports.blank(c).rows(df).schema == spark.createDataFrame([], c.gives).schema and c.unit in ("frame", "window", "clip", "segment")


def test_episode_table_in_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(n)) for k, n in zip(rng.permutation(3000), rng.integers(1, 9, 3000), strict=True)]
    got = {r["k"]: (r["episode_index"], r["frame_offset"]) for r in X.episode_table(spark.createDataFrame(rows, "k long, length long"), "k", "length").collect()}
    offset = 0
    for i, (k, n) in enumerate(sorted(rows)):
        assert got[k] == (i, offset)
        offset += n
