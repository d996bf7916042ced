"""Queries of scans, filters, predicates and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.operators import filters as P
from framewright.operators import sequences as S
from framewright.plans.registry import DET, FRAMES, RUNS, query
from framewright.sources import readers
from framewright.sources.adapters import detections, frames, hands, table, vectors


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
def scan_pruned(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_quantity").filter("l_quantity >= 45")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50")
def scan_json_props(spark, d):
    return readers.parsed(table(spark, d, "events"), "props", "k int").filter("p.k > 50").select("event_id", "p.k")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def scan_completed_semi(spark, d):
    return readers.completed(table(spark, d, "lineitem"), table(spark, d, "orders").filter("o_orderstatus = 'F'"), {"l_orderkey": "o_orderkey"}).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti_join(spark, d):
    return readers.todo(table(spark, d, "orders"), table(spark, d, "lineitem").filter("l_returnflag = 'R'"), {"o_orderkey": "l_orderkey"}).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2")
def dedup_last_shard(spark, d):
    return readers.last_shard(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"WITH {FRAMES} SELECT c_custkey AS clip_id, coalesce(max(frame_id), -1) AS max_frame FROM customer LEFT JOIN fr ON clip_id = c_custkey GROUP BY 1")
def max_frame_per_clip(spark, d):
    clips = table(spark, d, "customer").select(F.col("c_custkey").alias("clip_id"))
    top = frames(spark, d).groupBy("clip_id").agg(F.max("frame_id").alias("max_frame"))
    return clips.join(top, "clip_id", "left").select("clip_id", F.coalesce("max_frame", F.lit(-1)).alias("max_frame"))


@query("SELECT o_custkey, o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) - 1) // 500 AS INTEGER) AS shard FROM orders")
def chunk_rows(spark, d):
    o = table(spark, d, "orders").withColumn("clip", F.col("o_custkey") % 3)
    return readers.shard_numbers(o, ["clip"], "o_orderkey", 500).select("o_custkey", "o_orderkey", "shard")


_COUNTED = ("event_id", "ts", "user_id", "event_type", "value", "props")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n FROM events" for c in _COUNTED))
def columns_with_data(spark, d):
    return readers.columns_with_data(table(spark, d, "events"))


@query(f"""WITH {FRAMES}, a AS (SELECT clip_id, count(*) AS n_rows FROM fr GROUP BY 1), b AS (SELECT c_custkey AS clip_id, CAST(1 + c_custkey % 40 AS BIGINT) AS n_frames FROM customer)
SELECT clip_id, n_rows, n_frames, n_rows IS NOT DISTINCT FROM n_frames AS valid FROM a FULL JOIN b USING (clip_id)""")
def validate_counts(spark, d):
    a = frames(spark, d).groupBy("clip_id").agg(F.count(F.lit(1)).alias("n_rows"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("clip_id"), (1 + F.col("c_custkey") % 40).alias("n_frames"))
    return readers.pair_counts(a, b, "clip_id", "n_rows", "n_frames")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS seg FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT c_custkey AS seg FROM customer WHERE c_acctbal > 2000)
SELECT CASE WHEN b.seg IS NULL THEN 'annotation_only' WHEN a.seg IS NULL THEN 'video_only' ELSE 'kept' END AS status, count(*) AS n FROM a FULL JOIN b ON a.seg = b.seg GROUP BY 1""")
def discover_segments(spark, d):
    a = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("seg")).distinct()
    b = table(spark, d, "customer").filter("c_acctbal > 2000").select(F.col("c_custkey").alias("seg"))
    return readers.discovered(a, b, "seg").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand AS stem FROM part WHERE p_size < 3 UNION SELECT p_brand FROM part WHERE p_size > 48")
def stem_union(spark, d):
    p = table(spark, d, "part")
    return p.filter("p_size < 3").select(F.col("p_brand").alias("stem")).union(p.filter("p_size > 48").select("p_brand")).distinct()


@query("SELECT p_brand AS stem FROM part WHERE p_size < 3 EXCEPT SELECT p_brand FROM part WHERE p_size > 49")
def stem_except(spark, d):
    p = table(spark, d, "part")
    return p.filter("p_size < 3").select(F.col("p_brand").alias("stem")).subtract(p.filter("p_size > 49").select("p_brand"))


@query(f"WITH {DET} SELECT clip_id, frame_id FROM det WHERE side = 0 INTERSECT SELECT clip_id, frame_id FROM det WHERE side = 1")
def frame_intersect(spark, d):
    q = detections(spark, d)
    return q.filter("side = 0").select("clip_id", "frame_id").intersect(q.filter("side = 1").select("clip_id", "frame_id"))


@query(f"WITH {DET} SELECT event_id, round(conf, 6) AS conf FROM det WHERE conf > 0.2 AND side = 0")
def filter_conf(spark, d):
    return P.above(detections(spark, d), "conf", 0.2).filter("side = 0").select("event_id", F.round("conf", 6).alias("conf"))


@query(f"WITH {DET} SELECT clip_id, frame_id, count(*) AS n_hands, CAST(sum(event_id) AS BIGINT) AS ids FROM det WHERE x2 > x1 AND y2 > y1 GROUP BY 1, 2", name="filter_valid_boxes")
def _filter_valid_boxes(spark, d):
    h = P.valid_boxes(hands(spark, d).join(frames(spark, d).select("clip_id", "frame_id"), ["clip_id", "frame_id"]))
    ids = detections(spark, d).select("clip_id", "frame_id", "hand_idx", "event_id")
    kept = h.select("clip_id", "frame_id", F.size("hands").cast("long").alias("n_hands"), F.explode("hands.hand_idx").alias("hand_idx"))
    return kept.join(ids, ["clip_id", "frame_id", "hand_idx"]).groupBy("clip_id", "frame_id").agg(F.max("n_hands").alias("n_hands"), F.sum("event_id").alias("ids"))


@query(f"WITH {DET} SELECT clip_id, frame_id FROM det GROUP BY 1, 2 HAVING bool_or(conf > 0.1) AND frame_id % 5 <> 0")
def filter_contact_frames(spark, d):
    h = hands(spark, d).withColumn("pose_ok", F.col("frame_id") % 5 != 0)
    return P.contact(h, F.col("pose_ok"), lambda x: x["conf"] > 0.1).select("clip_id", "frame_id")


@query(f"""WITH {DET}, q AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame_id, side ORDER BY hand_idx) AS r FROM det)
SELECT clip_id, frame_id, max(CASE WHEN side = 0 AND r = 1 THEN round(conf, 6) END) AS left_conf, max(CASE WHEN side = 1 AND r = 1 THEN round(conf, 6) END) AS right_conf FROM q GROUP BY 1, 2""")
def pick_by_side(spark, d):
    h = hands(spark, d)
    return h.select("clip_id", "frame_id", *[F.round(P.hand_of("hands", side)["conf"], 6).alias(f"{name}_conf") for side, name in ((0, "left"), (1, "right"))])


@query("SELECT l_orderkey AS episode, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 4 AND 9")
def length_filter(spark, d):
    return P.length_between(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "episode"), ["episode"], 4, 9)


@query("""WITH q AS (SELECT l_orderkey AS episode, arg_min(CASE WHEN l_partkey % 10 <> 0 THEN l_returnflag END, (l_linenumber, l_partkey, l_suppkey)) AS language, count(*) FILTER (WHERE (l_linenumber, l_partkey, l_suppkey) IS NOT NULL) AS n, bool_and(coalesce(l_discount < 0.1, false)) AS valid FROM lineitem GROUP BY 1),
f AS (SELECT l_orderkey AS episode, CASE WHEN l_partkey % 10 <> 0 THEN l_returnflag END AS first_flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS r FROM lineitem)
SELECT q.episode, f.first_flag AS language FROM q JOIN f ON q.episode = f.episode AND f.r = 1 WHERE f.first_flag IS NOT NULL AND q.valid""")
def render_gate(spark, d):
    from framewright.sources.adapters import episodes

    e = episodes(spark, d).withColumn("language", F.when(F.col("l_partkey") % 10 != 0, F.col("l_returnflag"))).withColumn("ok", F.col("l_discount") < 0.1)
    return P.render_gate(e, ["episode"], "t", "language", "ok")


@query(f"WITH {FRAMES}, {RUNS} SELECT clip_id, run_id, (end_frame - start_frame + 1 = n_frames) AS dense FROM runs")
def assert_dense(spark, d):
    return P.dense(S.run_ids(frames(spark, d), ["clip_id"]), ["clip_id", "run_id"], "frame_id")


@query("SELECT event_id, user_id FROM events")
def project_whitelist(spark, d):
    return P.only(table(spark, d, "events"), ["event_id", "user_id", "absent_column"])


@query(f"WITH {DET} SELECT clip_id, frame_id, count(*) AS n, CAST(0 AS BIGINT) AS n_conf FROM det GROUP BY 1, 2")
def null_nested_field(spark, d):
    h = P.nulled(hands(spark, d), "hands", "conf")
    return h.select("clip_id", "frame_id", F.size("hands").cast("long").alias("n"), F.size(F.filter("hands.conf", lambda x: x.isNotNull())).cast("long").alias("n_conf"))


@query("SELECT count(*) FILTER (WHERE value IS NULL) AS n_null, count(*) FILTER (WHERE value < 0) AS n_negative, count(*) AS n FROM events")
def assert_not_null(spark, d):
    return P.violations(table(spark, d, "events"), {"n_null": F.col("value").isNull(), "n_negative": F.col("value") < 0})


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, CASE WHEN event_id % 2 = 0 THEN value * 2 END) AS focal, CASE WHEN event_id % 3 = 0 THEN 'primary' WHEN event_id % 2 = 0 THEN 'fallback' END AS model FROM events")
def coalesce_fallback(spark, d):
    e = table(spark, d, "events").withColumn("a", F.when(F.col("event_id") % 3 == 0, F.col("value"))).withColumn("b", F.when(F.col("event_id") % 2 == 0, F.col("value") * 2))
    return P.with_fallback(e, {"primary": "a", "fallback": "b"}, "focal", "model").select("event_id", "focal", "model")


@query("SELECT vec_id AS frame_id FROM embeddings WHERE vec_id % 4 <> 0 AND abs(embedding[1]) < 0.2")
def finite_vectors(spark, d):
    v = vectors(spark, d).withColumn("v", F.when(F.col("frame_id") % 4 == 0, F.transform("v", lambda x: x * float("nan"))).otherwise(F.col("v")))
    return P.finite(v, "v", 64).filter(F.abs(F.element_at("v", 1)) < 0.2).select("frame_id")


@query("""WITH l AS (SELECT * FROM (VALUES ('click', 0.0, 50.0), ('error', 10.0, 60.0), ('view', 5.0, 100.0)) AS t(name, lo, hi))
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE lo IS NULL) AS n_unknown, count(*) FILTER (WHERE value NOT BETWEEN lo AND hi) AS n_outside, count(*) FILTER (WHERE least(abs(value - lo), abs(value - hi)) < 1e-6) AS n_edge FROM events LEFT JOIN l ON event_type = name GROUP BY 1""")
def range_check(spark, d):
    limits = spark.createDataFrame([("click", 0.0, 50.0), ("error", 10.0, 60.0), ("view", 5.0, 100.0)], "name string, lo double, hi double")
    return P.range_check(table(spark, d, "events"), limits, "event_type", "value")


@query(f"WITH {DET} SELECT clip_id, side, frame_id, hand_idx, CASE WHEN bool_or(conf > 0.3) OVER (PARTITION BY clip_id, side) THEN round(conf, 6) ELSE 0.5 END AS state FROM det")
def default_fill(spark, d):
    q = P.default_fill(detections(spark, d), ["clip_id", "side"], F.col("conf") > 0.3, "conf", 0.5, "state")
    return q.select("clip_id", "side", "frame_id", "hand_idx", F.round("state", 6).alias("state"))


@query()
def hash_partition(spark, d):
    return readers.hash_part(table(spark, d, "customer"), "c_name", 2, 4).select("c_custkey", "c_name")


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) WHERE i % 4 = 1")
def index_partition(spark, d):
    return readers.index_part(table(spark, d, "customer"), "c_custkey", 2, 4).select("c_custkey")


@query(f"WITH {DET} SELECT clip_id, frame_id, hand_idx, round(1 - greatest(0, least(x2, 400) - greatest(x1, 0)) * greatest(0, least(y2, 300) - greatest(y1, 0)) / ((x2 - x1) * (y2 - y1)), 6) AS oob FROM det WHERE x2 > x1 AND y2 > y1")
def oob_ratio(spark, d):
    q = detections(spark, d).filter("x2 > x1 and y2 > y1")
    return q.select("clip_id", "frame_id", "hand_idx", F.round(P.outside_share("x1", "y1", "x2", "y2", 400, 300), 6).alias("oob"))


@query("""SELECT event_id, (value > 0 AND value / 250.0 BETWEEN 0.1 AND 8 AND abs(event_id % 400 - 200) / 400.0 <= 0.3) AS valid FROM events""")
def valid_intrinsics(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("value").alias("fx"), F.col("value").alias("fy"), (F.col("event_id") % 400).cast("double").alias("cx"), F.lit(200.0).alias("cy"), F.lit(0.0).alias("xi"), F.lit(400).alias("w"), F.lit(400).alias("h"))
    e = e.withColumn("fhat_scale", F.lit(250.0))
    return e.select("event_id", P.valid_intrinsics("fx", "fy", "cx", "cy", "xi", "w", "h", norm=F.col("fhat_scale")).alias("valid"))


@query(f"""WITH {FRAMES}, {RUNS}, c AS (SELECT s.clip_id, s.run_id, s.frame_id, s.n FROM s WHERE s.frame_id % 8 = 0) SELECT clip_id, run_id FROM c GROUP BY 1, 2 HAVING count(*) FILTER (WHERE n >= 2) < 1""")
def multi_person_gate(spark, d):
    f = S.run_ids(frames(spark, d), ["clip_id"])
    return P.crowd_gate(f, ["clip_id", "run_id"], "frame_id", "n", stride=8, people=2, frames=1)


@query(f"""WITH {FRAMES}, {RUNS}, e AS (SELECT clip_id, run_id, arg_min(value, frame_id) AS a, arg_max(value, frame_id) AS b, count(*) AS c FROM s GROUP BY 1, 2) SELECT clip_id, run_id FROM e WHERE c < 2 OR abs(b - a) <= 60""")
def camera_drift_filter(spark, d):
    f = S.run_ids(frames(spark, d), ["clip_id"]).withColumn("pos", F.array("value"))
    return P.drift_filter(f, ["clip_id", "run_id"], "frame_id", "pos", 60.0)
