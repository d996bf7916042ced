"""Queries of the joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.operators import matching as M
from framewright.operators import sequences as S
from framewright.plans.aggregates import TR, tracks
from framewright.plans.registry import DET, EP, FRAMES, LONG, RUNS, query
from framewright.plans.windows import _windows_sql
from framewright.sources.adapters import detections, episodes, frames, frames_long, hands, table


@query(f"WITH {FRAMES}, {DET}, a AS (SELECT clip_id, frame_id, count(*) AS n_left FROM det WHERE side = 0 GROUP BY 1, 2) SELECT clip_id, frame_id, event_id, coalesce(n_left, 0) AS n_left FROM fr LEFT JOIN a USING (clip_id, frame_id)")
def frames_left_join(spark, d):
    a = detections(spark, d).filter("side = 0").groupBy("clip_id", "frame_id").agg(F.count(F.lit(1)).alias("n_left"))
    return frames(spark, d).join(a, ["clip_id", "frame_id"], "left").select("clip_id", "frame_id", "event_id", F.coalesce("n_left", F.lit(0)).alias("n_left"))


@query("SELECT o_orderkey, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F'")
def broadcast_dim(spark, d):
    """Star join; the optimizer broadcasts the dimensions that are small enough."""
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "nation")


@query(f"""WITH w AS ({_windows_sql(LONG, 210, 105)}), {LONG} SELECT w.clip_id, w.w_start, w.w_end, count(*) AS n FROM w JOIN fr ON w.clip_id = fr.clip_id AND fr.frame_id BETWEEN w.w_start AND w.w_end GROUP BY 1, 2, 3""")
def window_range_join(spark, d):
    w = S.sliding_windows(S.gap_sessions(frames_long(spark, d), ["clip_id"]), 210, 105).select("clip_id", "w_start", "w_end")
    return M.in_windows(frames_long(spark, d), w, ["clip_id"]).groupBy("clip_id", "w_start", "w_end").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH w0 AS ({_windows_sql(LONG, 210, 105)}), {LONG}, w AS (SELECT *, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY w_start, w_end) AS INTEGER) AS w_no FROM w0),
m AS (SELECT w.clip_id, w.w_no, fr.frame_id FROM w JOIN fr ON w.clip_id = fr.clip_id AND fr.frame_id BETWEEN w.w_start AND w.w_end)
SELECT a.clip_id, a.w_no, count(*) AS n_shared FROM m a JOIN m b ON a.clip_id = b.clip_id AND a.w_no = b.w_no + 1 AND a.frame_id = b.frame_id GROUP BY 1, 2 HAVING count(*) >= 2""")
def window_overlap_join(spark, d):
    w = S.sliding_windows(S.gap_sessions(frames_long(spark, d), ["clip_id"]), 210, 105)
    w = w.withColumn("w_no", F.row_number().over(Window.partitionBy("clip_id").orderBy("w_start", "w_end"))).select("clip_id", "w_start", "w_end", "w_no")
    return M.window_overlaps(w, M.in_windows(frames_long(spark, d), w, ["clip_id"]), ["clip_id"])


@query(f"""WITH {TR}, m AS (SELECT DISTINCT clip_id, side, frame_id, CAST(event_id % 5 AS INTEGER) AS tk FROM tr) SELECT a.clip_id, a.side, a.tk AS a, b.tk AS b, count(*) AS n_frames FROM m a JOIN m b ON a.clip_id = b.clip_id AND a.side = b.side AND a.frame_id = b.frame_id AND a.tk < b.tk GROUP BY ALL""")
def track_conflict_pairs(spark, d):
    q = tracks(spark, d).withColumn("tk", (F.col("event_id") % 5).cast("int"))
    return M.conflicts(q, ["clip_id"], "tk", "side", "frame_id")


_OVER = "greatest(0, least(s.x2, b.x2) - greatest(s.x1, b.x1)) * greatest(0, least(s.y2, b.y2) - greatest(s.y1, b.y1)) / nullif(least((s.x2 - s.x1) * (s.y2 - s.y1), (b.x2 - b.x1) * (b.y2 - b.y1)), 0)"


@query(f"""WITH {DET}, ok AS (SELECT *, event_id AS seed, event_id % 12 AS k FROM (SELECT clip_id, frame_id, event_id, hand_idx + frame_id * 100 AS hand_idx, x1, y1, x1 + 100 AS x2, y1 + 100 AS y2 FROM det)),
j AS (SELECT s.clip_id, s.seed, b.hand_idx, {_OVER} AS o FROM ok s JOIN ok b ON s.clip_id = b.clip_id AND s.event_id % 7 = 0 AND b.event_id % 7 <> 0)
SELECT clip_id, seed, hand_idx, round(o, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, seed ORDER BY o DESC, hand_idx) AS r FROM j WHERE o > 0.5) WHERE r = 1""")
def overlap_argmax(spark, d):
    q = detections(spark, d).withColumn("hand_idx", F.col("hand_idx") + F.col("frame_id") * 100).withColumn("x2", F.col("x1") + 100).withColumn("y2", F.col("y1") + 100)
    seeds, boxes = q.filter("event_id % 7 = 0").withColumn("seed", F.col("event_id")), q.filter("event_id % 7 <> 0")
    return M.best_overlap(seeds, boxes, ["clip_id"]).withColumn("overlap", F.round("overlap", 6))


@query(f"WITH {DET} SELECT clip_id, frame_id, CAST(row_number() OVER (PARTITION BY clip_id, frame_id ORDER BY hand_idx) - 1 AS INTEGER) AS place, hand_idx, 1 - side AS side, round(0.5 + conf / 2, 6) AS side_conf FROM det WHERE event_id % 3 <> 0")
def apply_track_updates(spark, d):
    u = detections(spark, d).filter("event_id % 3 <> 0").select("clip_id", "frame_id", "hand_idx", (1 - F.col("side")).alias("side"), (0.5 + F.col("conf") / 2).alias("side_conf"))
    out = M.updated(hands(spark, d), u, ["clip_id", "frame_id"])
    return out.select("clip_id", "frame_id", F.posexplode("hands").alias("place", "h")).select("clip_id", "frame_id", "place", "h.hand_idx", "h.side", F.round("h.side_conf", 6).alias("side_conf"))


@query(f"""WITH {TR}, l AS (SELECT clip_id, track, frame_id, side, side_conf FROM tr WHERE track % 2 = 1), w AS (SELECT clip_id, frame_id - 10 AS frame_id, side FROM tr WHERE track % 2 = 0),
g AS (SELECT l.clip_id, l.track, max(l.side) AS old, max(side_conf) AS conf, count(DISTINCT w.side) AS k, max(w.side) AS ws FROM l LEFT JOIN w USING (clip_id, frame_id) GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN k = 1 THEN 1 - ws ELSE 1 - old END AS side FROM g) SELECT clip_id, CAST(track AS INTEGER) AS track, CAST(side AS INTEGER) AS side, round(CASE WHEN side <> old THEN 1 - conf ELSE conf END, 6) AS side_conf FROM f""")
def loser_flip(spark, d):
    t = tracks(spark, d)
    losers = t.filter("track % 2 = 1").select("clip_id", "track", "frame_id", "side", "side_conf")
    winners = t.filter("track % 2 = 0").select("clip_id", (F.col("frame_id") - 10).alias("frame_id"), "side")
    return M.flipped(losers, winners, ["clip_id"]).withColumn("side_conf", F.round("side_conf", 6))


@query(f"WITH {EP} SELECT a.episode, a.t, a.l_quantity AS state, b.l_tax AS error FROM ep a JOIN ep b USING (episode, t) WHERE b.l_discount > 0.05")
def align_tables(spark, d):
    e = episodes(spark, d)
    return e.select("episode", "t", F.col("l_quantity").alias("state")).join(e.filter("l_discount > 0.05").select("episode", "t", F.col("l_tax").alias("error")), ["episode", "t"])


@query(f"""WITH {EP}, b AS (SELECT o_custkey AS episode, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS t, o_totalprice FROM orders) SELECT episode, t, l_quantity, o_totalprice FROM ep JOIN b USING (episode, t)""")
def zip_shortest(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("episode"), (F.row_number().over(S.by(["o_custkey"], "o_orderkey")) - 1).cast("int").alias("t"), "o_totalprice")
    return M.zipped(episodes(spark, d).select("episode", "t", "l_quantity"), o, ["episode"], "t")


@query("""WITH RECURSIVE l AS (SELECT CAST(p_partkey AS BIGINT) AS node, CASE WHEN p_partkey > 0 THEN CAST((p_partkey - 1) // 3 AS BIGINT) END AS parent FROM part),
c AS (SELECT node, parent AS ancestor, 1 AS steps FROM l WHERE parent IS NOT NULL UNION ALL SELECT c.node, l.parent, steps + 1 FROM c JOIN l ON c.ancestor = l.node WHERE l.parent IS NOT NULL) SELECT * FROM c""")
def recursive_chain(spark, d):
    p = table(spark, d, "part")
    links = p.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 0, F.floor((F.col("p_partkey") - 1) / 3)).alias("parent"))
    return M.ancestors(links, "node", "parent")


_NAMES = ["a", "b", "c", "d", "e", "f", "g", "h"]


@query("""SELECT vec_id AS frame_id, i AS i, round(CASE i WHEN 0 THEN v[3] WHEN 1 THEN 0 WHEN 2 THEN v[1] ELSE v[2] END, 6) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS i)""")
def joint_remap(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("v"))
    return v.select("frame_id", F.posexplode(M.remapped(F.col("v"), ["a", "b", "c"], ["c", "x", "a", "b"])).alias("i", "x")).withColumn("x", F.round("x", 6))


@query("""SELECT vec_id AS frame_id, i, round(CASE i WHEN 0 THEN v[1] WHEN 1 THEN v[1] * 0.5::DOUBLE + 0.1::DOUBLE ELSE v[3] END, 6) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS i)""")
def mimic_joints(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("embedding").cast("array<double>").alias("v"))
    return v.select("frame_id", F.posexplode(M.mimicked(F.col("v"), ["a", "b", "c"], {"b": ("a", 0.5, 0.1)})).alias("i", "x")).withColumn("x", F.round("x", 6))


@query("""SELECT s.p_brand AS name FROM (SELECT DISTINCT p_brand FROM part WHERE p_size < 5) s WHERE s.p_brand NOT IN (SELECT p_brand FROM part WHERE p_size > 48)""")
def missing_joints(spark, d):
    p = table(spark, d, "part")
    # the lists hold the distinct names of a robot's joints
    one = p.agg(F.collect_set(F.when(F.col("p_size") < 5, F.col("p_brand"))).alias("want"), F.collect_set(F.when(F.col("p_size") > 48, F.col("p_brand"))).alias("have"))
    return one.select(F.explode(F.array_except("want", "have")).alias("name"))
