"""Queries of the annotation operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from framewright.functions import camera
from framewright.operators import annotations as A
from framewright.plans.registry import DET, EP, FRAMES, query
from framewright.sources.adapters import detections, episodes, frames, table


@query(f"WITH {FRAMES}, u AS (SELECT clip_id, frame_id, value * 2 AS value FROM fr WHERE frame_id % 3 = 0) SELECT fr.clip_id, fr.frame_id, coalesce(u.value, fr.value) AS value FROM fr LEFT JOIN u ON fr.clip_id = u.clip_id AND fr.frame_id = u.frame_id")
def append_in_place(spark, d):
    f = frames(spark, d).select("clip_id", "frame_id", "value")
    return A.with_column_in_place(f, f.filter("frame_id % 3 = 0").withColumn("value", F.col("value") * 2), ["clip_id", "frame_id"], "value")


@query(f"WITH {DET} SELECT clip_id, frame_id, string_agg(hand_idx || ':' || CASE WHEN hand_idx % 2 = 0 THEN 1 - side ELSE side END, ',' ORDER BY hand_idx) AS sides FROM det GROUP BY 1, 2")
def renest_updates(spark, d):
    q = detections(spark, d)
    nested = q.groupBy("clip_id", "frame_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("hand_idx", "side", "conf"))), lambda x: x).alias("hands"))
    new = q.filter("hand_idx % 2 = 0").select("clip_id", "frame_id", F.col("hand_idx").alias("place"), (1 - F.col("side")).alias("side"))
    out = A.renested(nested, new, ["clip_id", "frame_id"], "hands", ["side"])
    return out.select("clip_id", "frame_id", F.array_join(F.transform("hands", lambda h: F.concat(h["hand_idx"].cast("string"), F.lit(":"), h["side"].cast("string"))), ",").alias("sides"))


@query(f"WITH {DET} SELECT coalesce(CASE WHEN x2 <= x1 OR y2 <= y1 THEN 'empty_box' WHEN conf < 0.05 THEN 'low_score' WHEN x1 < 5 THEN 'edge' END, 'kept') AS reason, count(*) AS n FROM det GROUP BY 1")
def reject_book(spark, d):
    why = {"empty_box": (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")), "low_score": F.col("conf") < 0.05, "edge": F.col("x1") < 5}
    return A.reject_table(A.judged(detections(spark, d), why))


@query("""WITH q AS (SELECT p_size AS win, p_partkey AS s, CASE WHEN p_partkey % 41 = 0 THEN 'walking' WHEN p_partkey % 59 = 0 THEN 'other_person' END AS v, CASE WHEN p_partkey % 13 = 0 THEN 'continuous_generic' WHEN p_partkey % 17 = 0 THEN 'continuous_tool' END AS t FROM part)
SELECT * FROM (SELECT win, coalesce(arg_min(v, s) FILTER (WHERE v IS NOT NULL), arg_min(t, s) FILTER (WHERE t IS NOT NULL)) AS code FROM q GROUP BY 1) WHERE code IS NOT NULL""")
def first_rejection(spark, d):
    k = F.col("p_partkey")
    visual = F.when(k % 41 == 0, "walking").when(k % 59 == 0, "other_person")
    text = F.when(k % 13 == 0, "continuous_generic").when(k % 17 == 0, "continuous_tool")
    return A.first_rejection(table(spark, d, "part").withColumnRenamed("p_size", "win"), ["win"], "p_partkey", visual, text)


@query(f"""WITH {DET}, q AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_id, side ORDER BY conf DESC, hand_idx) AS r FROM det)
SELECT clip_id, frame_id, hand_idx, side, CASE WHEN r > 1 THEN least(conf, 0.49::DOUBLE) ELSE conf END AS conf FROM q""")
def side_claims(spark, d):
    return A.side_claims(detections(spark, d), ["clip_id", "frame_id"], "side", "conf", [F.desc("conf"), F.col("hand_idx")]).select("clip_id", "frame_id", "hand_idx", "side", "conf")


@query(f"""WITH {DET}, q AS (SELECT *, x1 + (x2 - x1) * 0.5::DOUBLE AS x, y1 + (y2 - y1) * 0.5::DOUBLE AS y, greatest(x2 - x1, y2 - y1) * 1.2::DOUBLE * 0.5::DOUBLE AS h FROM det WHERE x2 > x1 AND y2 > y1)
SELECT event_id, greatest(0, CAST(trunc(x - h) AS INTEGER)) AS rx1, greatest(0, CAST(trunc(y - h) AS INTEGER)) AS ry1, least(640, CAST(trunc(x + h) AS INTEGER)) AS rx2, least(480, CAST(trunc(y + h) AS INTEGER)) AS ry2 FROM q""")
def mask_fallback_box(spark, d):
    q = detections(spark, d).filter("x2 > x1 and y2 > y1")
    return q.select("event_id", A.square(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], 640, 480).alias("s")).select("event_id", "s.*")


@query(f"WITH {FRAMES} SELECT clip_id, frame_id // 40 AS win, CASE WHEN count(value) < 3 THEN 'nan'::DOUBLE ELSE quantile_cont(value, 0.5) END AS scale FROM fr GROUP BY 1, 2")
def min_count_median(spark, d):
    return frames(spark, d).groupBy("clip_id", F.floor(F.col("frame_id") / 40).cast("int").alias("win")).agg(A.median_of_several(F.col("value")).alias("scale"))


@query(f"""WITH {EP}, p AS (SELECT a.episode, sqrt(pow(a.l_quantity - b.l_quantity, 2) + pow(a.l_tax - b.l_tax, 2) + pow(a.l_linenumber - b.l_linenumber, 2)) AS s, sqrt(pow(a.l_quantity - b.l_quantity, 2) + pow(a.l_discount - b.l_discount, 2) + pow(a.t - b.t, 2)) AS r FROM ep a JOIN ep b ON a.episode = b.episode AND a.t < b.t),
m AS (SELECT episode, quantile_cont(CASE WHEN s > 1e-9 THEN r / s END, 0.5) AS m FROM p GROUP BY 1)
SELECT e.episode, round(CASE WHEN m BETWEEN 0.5 AND 2 THEN m ELSE 1.0 END, 6) AS scale FROM (SELECT DISTINCT episode FROM ep) e LEFT JOIN m ON e.episode = m.episode""")
def pairwise_scale(spark, d):
    e = episodes(spark, d).select("episode", F.col("t").alias("k"), F.col("t").cast("double").alias("t"), "l_quantity", "l_tax", F.col("l_linenumber").cast("double").alias("l_linenumber"), "l_discount")
    return A.distance_scale(e, ["episode"], "k", ["l_quantity", "l_tax", "l_linenumber"], ["l_quantity", "l_discount", "t"]).withColumn("scale", F.round("scale", 6))


@query("""WITH q AS (SELECT p_partkey AS clip_id, (p_size - 10) / 1000.0::DOUBLE AS xi, p_retailprice % 2::DOUBLE AS p99 FROM part)
SELECT clip_id, CASE WHEN xi < 0 THEN CASE WHEN -xi > 0.005 THEN NULL ELSE false END WHEN xi < 1e-6 THEN false ELSE p99 >= 0.5 END AS undistort FROM q""")
def undistort_state(spark, d):
    xi, p99 = (F.col("p_size") - 10) / 1000.0, F.col("p_retailprice") % 2
    return table(spark, d, "part").select(F.col("p_partkey").alias("clip_id"), camera.undistortion(xi, p99, negative=0.005).alias("undistort"))


@query("""WITH q AS (SELECT vec_id AS frame_id, embedding[1]::DOUBLE AS pitch, embedding[2]::DOUBLE AS roll FROM embeddings) SELECT frame_id FROM q WHERE pitch < 0 AND abs(roll) <= 10 * pi() / 180""")
def gravity_frames(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), F.element_at("embedding", 1).cast("double").alias("pitch"), F.element_at("embedding", 2).cast("double").alias("roll"))
    return v.filter(camera.level(F.col("pitch"), F.col("roll"), 10 * math.pi / 180)).select("frame_id")


@query(f"""WITH {FRAMES}, v AS (SELECT *, event_id % 5 <> 0 AS ok, event_id % 97 * 10.0::DOUBLE AS y FROM fr), q AS (SELECT clip_id, frame_id, ok, coalesce(sqrt(pow(value - lag(value) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS s, coalesce(sqrt(pow(lead(value) OVER w - 2 * value + lag(value) OVER w, 2) + pow(lead(y) OVER w - 2 * y + lag(y) OVER w, 2)), 0) AS a FROM v WINDOW w AS (PARTITION BY clip_id ORDER BY frame_id))
SELECT clip_id, frame_id, round(CASE WHEN ok THEN greatest(exp(-pow(greatest(s, a) * 30 / 20000.0, 4)), 0.01) ELSE 0 END, 6) AS weight FROM q""")
def speed_weight_points(spark, d):
    from framewright.operators import sequences as S

    f = frames(spark, d).withColumn("ok", F.col("event_id") % 5 != 0).withColumn("y", F.col("event_id") % 97 * 10.0)
    return S.speed_weights(f, ["clip_id"], "frame_id", ["value", "y"], 20000.0, 30.0, "weight", valid="ok").select("clip_id", "frame_id", F.round("weight", 6).alias("weight"))
