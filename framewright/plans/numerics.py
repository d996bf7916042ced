"""Queries of the order-dependent numeric operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import masks
from framewright.operators import ordered as O
from framewright.operators import robust as R
from framewright.operators import sequences as S
from framewright.plans.aggregates import tracks
from framewright.plans.registry import query
from framewright.sources.adapters import detections, vectors


def _poses(spark, d):
    v = vectors(spark, d)
    return v.select("clip_id", F.floor(F.col("frame_id") / 100).cast("int").alias("run_id"), "frame_id", F.slice("v", 1, 4).alias("q"), F.slice("v", 5, 3).alias("t"), F.slice("v", 8, 4).alias("ref_q"), F.slice("v", 12, 3).alias("ref_t"), "v")


@query()
def quat_mean(spark, d):
    return O.mean_rotation(_poses(spark, d), ["clip_id"], "frame_id", "q", running=True)


@query()
def quat_mean_first(spark, d):
    return O.mean_rotation(_poses(spark, d), ["clip_id"], "frame_id", "q", running=False)


@query("""WITH q AS (SELECT vec_id AS frame_id, v[1] / n AS x, v[2] / n AS y, v[3] / n AS z, v[4] / n AS w FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum([a::DOUBLE * a::DOUBLE FOR a IN embedding[1:4]])) AS n FROM embeddings))
SELECT frame_id, round(1 - 2 * (y * y + z * z), 6) + 0.0::DOUBLE AS r00, round(2 * (x * y - z * w), 6) + 0.0::DOUBLE AS r01, round(2 * (x * z + y * w), 6) + 0.0::DOUBLE AS r02,
round(2 * (x * y + z * w), 6) + 0.0::DOUBLE AS r10, round(1 - 2 * (x * x + z * z), 6) + 0.0::DOUBLE AS r11, round(2 * (y * z - x * w), 6) + 0.0::DOUBLE AS r12,
round(2 * (x * z - y * w), 6) + 0.0::DOUBLE AS r20, round(2 * (y * z + x * w), 6) + 0.0::DOUBLE AS r21, round(1 - 2 * (x * x + y * y), 6) + 0.0::DOUBLE AS r22 FROM q""")
def quat_to_matrix(spark, d):
    """In column expressions, as the closed form needs no order."""
    v = vectors(spark, d)
    n = F.sqrt(F.aggregate(F.slice("v", 1, 4), F.lit(0.0), lambda s, a: s + a * a))
    x, y, z, w = (F.get("v", i) / n for i in range(4))
    r = {"r00": 1 - 2 * (y * y + z * z), "r01": 2 * (x * y - z * w), "r02": 2 * (x * z + y * w)}
    r |= {"r10": 2 * (x * y + z * w), "r11": 1 - 2 * (x * x + z * z), "r12": 2 * (y * z - x * w), "r20": 2 * (x * z - y * w), "r21": 2 * (y * z + x * w), "r22": 1 - 2 * (x * x + y * y)}
    return v.select("frame_id", *[(F.round(c, 6) + 0.0).alias(k) for k, c in r.items()])


@query()
def slerp_smooth(spark, d):
    return O.smoothed_rotations(_poses(spark, d), ["clip_id"], "frame_id", "q", S.gaussian(13, 2.0), 13)


@query()
def interp_poses(spark, d):
    p = _poses(spark, d)
    hide = F.col("frame_id") % 3 != 0
    return O.interpolated_poses(p.withColumn("q", F.when(hide, F.col("q"))).withColumn("t", F.when(hide, F.col("t"))), ["clip_id"], "frame_id", "q", "t")


@query()
def sim3_align(spark, d):
    return O.aligned(_poses(spark, d), ["clip_id", "run_id"], "frame_id")


@query()
def up_vector(spark, d):
    return O.up_vectors(_poses(spark, d).withColumn("up", F.slice("v", 20, 3)), ["clip_id", "run_id"], "frame_id", "up")


@query()
def mask_or(spark, d):
    q = detections(spark, d).select("clip_id", "frame_id", F.concat(F.lit(masks.encode(__import__("numpy").zeros((2, 32), bool))[:12]), F.unhex(F.lpad(F.hex(F.col("event_id") * 2654435761 % 4294967296), 16, "0"))).alias("m"))
    return q.groupBy("clip_id", "frame_id").agg(masks.united("m").alias("m")).select("clip_id", "frame_id", F.hex("m").alias("mask"), masks.area("m").alias("area"))


@query()
def nms(spark, d):
    q = detections(spark, d).filter("x2 > x1 and y2 > y1").withColumn("slot", F.floor(F.col("frame_id") / 20).cast("int"))
    q = q.withColumn("x2", F.col("x1") + 150).withColumn("y2", F.col("y1") + 150).select("clip_id", "slot", "event_id", "x1", "y1", "x2", "y2", "conf")
    return O.suppressed(q, ["clip_id", "slot"], ("x1", "y1", "x2", "y2"), "conf", "event_id", 0.3)


def _tracks(spark, d):
    t = tracks(spark, d).withColumn("track", (F.col("event_id") % 6).cast("int"))
    v = R.side_vote(t, ["clip_id", "track"], "side", "side_conf", "conf").withColumn("evidence", F.col("side_conf") * F.col("n"))
    more = t.groupBy("clip_id", "track").agg(F.avg((F.col("x1") + F.col("x2")) / 2).alias("mean_x"), F.sort_array(F.collect_set("frame_id")).alias("frames"))
    return v.join(more, ["clip_id", "track"]).select("clip_id", "track", "side", "evidence", F.size("frames").alias("n"), "mean_x", "frames")


@query()
def greedy_conflict(spark, d):
    return O.winners(_tracks(spark, d), ["clip_id"], 3, 400.0)


@query()
def cosine_pair_error(spark, d):
    v = vectors(spark, d).select("frame_id", F.slice("v", 1, 30).alias("a"), F.slice("v", 31, 30).alias("b"))
    return O.pair_direction_error(v, ["frame_id"], "a", "b", [(i, j) for i in range(10) for j in range(i + 1, 10) if j - i <= 2])
