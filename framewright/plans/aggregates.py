"""Queries of the aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.operators import robust as R
from framewright.operators import sequences as S
from framewright.plans.registry import DET, EP, FRAMES, RUNS, query
from framewright.sources.adapters import detections, episodes, frames, table

TRACK = ["clip_id", "track"]


def tracks(spark, d):
    """Detections with a track number (slots of ten frames, cut towards zero) and a side confidence."""
    q = detections(spark, d).withColumn("track", F.expr("cast(frame_id div 10 as int)"))
    return q.withColumn("side_conf", 0.5 + F.col("event_id") % 50 / 100)


TR = f"{DET}, tr AS (SELECT *, frame_id // 10 AS track, 0.5::DOUBLE + (event_id % 50)::DOUBLE / 100 AS side_conf FROM det)"
_VOTE = "vote AS (SELECT clip_id, track, sum(CASE WHEN side = 1 THEN side_conf ELSE 1 - side_conf END * conf) / sum(conf) AS p_right, count(*) AS n FROM tr GROUP BY 1, 2)"


@query(f"WITH {TR}, {_VOTE} SELECT clip_id, track, round(p_right, 6) AS p_right, n, CAST(p_right >= 0.5 AS INTEGER) AS side, round(greatest(p_right, 1 - p_right), 6) AS side_conf FROM vote")
def weighted_side_vote(spark, d):
    v = R.side_vote(tracks(spark, d), TRACK, "side", "side_conf", "conf")
    return v.select("clip_id", "track", F.round("p_right", 6).alias("p_right"), "n", "side", F.round("side_conf", 6).alias("side_conf"))


@query(f"""WITH {TR}, {_VOTE}, e AS (SELECT clip_id, track, round(greatest(p_right, 1 - p_right) * n, 6) AS evidence FROM vote)
SELECT *, CAST(row_number() OVER (PARTITION BY clip_id ORDER BY evidence DESC, track) AS INTEGER) AS place FROM e""")
def evidence_rank(spark, d):
    v = R.side_vote(tracks(spark, d), TRACK, "side", "side_conf", "conf").withColumn("evidence", F.round(F.col("side_conf") * F.col("n"), 6))
    return v.withColumn("place", F.row_number().over(Window.partitionBy("clip_id").orderBy(F.desc("evidence"), "track"))).select("clip_id", "track", "evidence", "place")


@query("""WITH m AS (SELECT l_orderkey AS episode, count(*) AS n, quantile_cont(l_extendedprice, 0.5) AS ma, quantile_cont(l_quantity, 0.5) AS mb FROM lineitem GROUP BY 1),
j AS (SELECT m.*, l_extendedprice AS a, l_quantity AS b FROM lineitem JOIN m ON episode = l_orderkey),
q AS (SELECT episode, quantile_cont(abs(a - ma), 0.5) AS da, quantile_cont(abs(b - mb), 0.5) AS db FROM j GROUP BY 1),
k AS (SELECT j.*, j.n < 5 OR (abs(a - ma) <= t * greatest(da * 1.4826, 1e-8) AND abs(b - mb) <= t * greatest(db * 1.4826, 1e-8)) AS ok FROM (SELECT *, CASE WHEN n <= 6 THEN 4.0::DOUBLE WHEN n <= 9 THEN 3.5 ELSE 3.0 END AS t FROM j) j JOIN q USING (episode))
SELECT episode, max(n) AS n, round(coalesce(quantile_cont(a, 0.5) FILTER (WHERE ok), max(ma)), 4) AS price, round(coalesce(quantile_cont(b, 0.5) FILTER (WHERE ok), max(mb)), 4) AS quantity FROM k GROUP BY 1""")
def mad_filter_median(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return R.mad_median(e, ["episode"], ["price", "quantity"]).select("episode", "n", F.round("price", 4).alias("price"), F.round("quantity", 4).alias("quantity"))


@query(f"""WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame_id DESC) AS r FROM fr), f AS (SELECT clip_id, quantile_cont(value, 0.5) AS ref FROM r WHERE r <= 3 GROUP BY 1),
o AS (SELECT r.clip_id, quantile_cont(value, 0.5) FILTER (WHERE abs(value - ref) <= 0.2::DOUBLE * abs(ref)) AS med, count(*) FILTER (WHERE abs(value - ref) <= 0.2::DOUBLE * abs(ref)) AS n FROM r JOIN f USING (clip_id) GROUP BY 1),
g AS (SELECT r.clip_id, max(med) AS med, count(*) FILTER (WHERE abs(value - med) <= 0.2::DOUBLE * abs(med)) AS n_near FROM r LEFT JOIN (SELECT * FROM o WHERE n >= 3) o ON r.clip_id = o.clip_id GROUP BY 1)
SELECT clip_id, CASE WHEN n_near >= 3 THEN round(med, 6) END AS estimate, n_near FROM g""")
def early_stop_median(spark, d):
    return R.stable_median(frames(spark, d), ["clip_id"], "frame_id", "value", tolerance=0.2).withColumn("estimate", F.round("estimate", 6))


@query(f"""WITH {DET}, m AS (SELECT clip_id, side, quantile_cont((x1 + x2) / 2, 0.5) AS x, quantile_cont((y1 + y2) / 2, 0.5) AS y FROM det GROUP BY 1, 2) SELECT clip_id, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM m GROUP BY 1""")
def centroid_of_medians(spark, d):
    q = detections(spark, d)
    m = q.groupBy("clip_id", "side").agg(F.percentile((F.col("x1") + F.col("x2")) / 2, F.lit(0.5)).alias("x"), F.percentile((F.col("y1") + F.col("y2")) / 2, F.lit(0.5)).alias("y"))
    return m.groupBy("clip_id").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


_VEC = "v AS (SELECT label AS clip_id, vec_id AS frame_id, embedding::DOUBLE[] AS v FROM embeddings)"


@query(f"""WITH {_VEC}, q AS (SELECT clip_id, v[1] AS x, v[2] AS y, 1 + frame_id % 3 AS w, sqrt(v[1] * v[1] + v[2] * v[2]) AS n FROM v)
SELECT clip_id, round(degrees(atan2(sum(w / n * y) FILTER (WHERE n > 0.05), sum(w / n * x) FILTER (WHERE n > 0.05))), 6) AS angle FROM q GROUP BY 1""")
def circular_mean(spark, d):
    from framewright.sources.adapters import vectors

    v = vectors(spark, d).select("clip_id", F.element_at("v", 1).alias("x"), F.element_at("v", 2).alias("y"), (1 + F.col("frame_id") % 3).alias("w"))
    return R.circular_mean(v, ["clip_id"], "x", "y", "w").withColumn("angle", F.round("angle", 6))


_DIAG = "dg AS (SELECT l_orderkey AS episode, avg(l_tax) AS tax, avg(CASE WHEN l_linenumber <> 3 THEN l_discount END) AS discount FROM lineitem GROUP BY 1)"


def _diag(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode"), F.array("l_tax").alias("tax"), F.array(F.when(F.col("l_linenumber") != 3, F.col("l_discount")).otherwise(float("nan"))).alias("discount"))
    return R.array_means(e, ["episode"], ["tax", "discount"])


@query(f"WITH {_DIAG} SELECT episode, round(tax, 6) AS tax, round(coalesce(discount, 'nan'::DOUBLE), 6) AS discount FROM dg")
def episode_diag_means(spark, d):
    return _diag(spark, d).select("episode", F.round("tax", 6).alias("tax"), F.round("discount", 6).alias("discount"))


@query(f"WITH {_DIAG} SELECT round(quantile_cont(tax, 0.99), 6) AS tax, round(quantile_cont(discount, 1.0), 6) AS discount FROM dg")
def diag_percentiles(spark, d):
    return R.thresholds(_diag(spark, d), {"tax": 0.99, "discount": 1.0}).select(F.round("tax", 6).alias("tax"), F.round("discount", 6).alias("discount"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)")
def diag_filter(spark, d):
    return R.within_thresholds(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), {"o_totalprice": 0.99}).select("o_orderkey")


@query(f"""WITH {_VEC}, w AS (SELECT clip_id, frame_id // 100 AS slot, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS i FROM v) SELECT clip_id, slot, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS x FROM w GROUP BY 1, 2, 3""")
def overlap_mean(spark, d):
    from framewright.sources.adapters import vectors

    v = vectors(spark, d).select("clip_id", F.floor(F.col("frame_id") / 100).alias("slot"), F.posexplode("v").alias("i", "x"))
    return v.groupBy("clip_id", "slot", "i").agg(F.round(F.avg("x"), 6).alias("x"))


@query("SELECT l_orderkey AS episode, CAST((sum(l_partkey) + count(*) // 2) // count(*) AS BIGINT) AS mean FROM lineitem GROUP BY 1")
def rounded_mean(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("episode")).agg(R.rounded_mean("l_partkey").alias("mean"))


@query(f"""WITH {EP}, q AS (SELECT episode, l_quantity AS x, greatest(0.5 * (1 + cos(pi() * (t - (count(*) OVER (PARTITION BY episode) - 1) / 2::DOUBLE) / (count(*) OVER (PARTITION BY episode) / 2::DOUBLE))), 1e-6) AS w FROM ep)
SELECT episode, round(sum(w * x) / sum(w), 6) AS x, count(*) AS n FROM q GROUP BY 1""")
def cosine_blend(spark, d):
    e = episodes(spark, d).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("episode"))).withColumnRenamed("l_quantity", "x")
    return R.cosine_blend(e, ["episode"], "t", "size", "x").withColumn("x", F.round("x", 6))


@query(f"""WITH {DET}, q AS (SELECT clip_id, frame_id, bool_or(side = 0 AND conf > 0.1) AS l, bool_or(side = 1 AND conf > 0.1) AS r FROM det GROUP BY 1, 2) SELECT clip_id, frame_id, CASE WHEN l AND r THEN 'bimanual' WHEN l THEN 'left_only' ELSE 'right_only' END AS mode FROM q WHERE l OR r""")
def hand_mode(spark, d):
    ok = F.col("conf") > 0.1
    return R.mode(detections(spark, d), ["clip_id", "frame_id"], (F.col("side") == 0) & ok, (F.col("side") == 1) & ok)


@query(f"""WITH {FRAMES}, {RUNS}, q AS (SELECT clip_id, run_id, quantile_cont(value, 0.5) AS dist, (arg_max(event_id % 360, frame_id) - arg_min(event_id % 360, frame_id))::DOUBLE AS turn FROM s GROUP BY 1, 2)
SELECT clip_id, run_id, abs(((turn + 180) % 360 + 360) % 360 - 180) AS delta FROM q WHERE dist > 30 AND abs(((turn + 180) % 360 + 360) % 360 - 180) > 20""")
def wrong_hand_outlier(spark, d):
    f = S.run_ids(frames(spark, d), ["clip_id"]).withColumn("yaw", (F.col("event_id") % 360).cast("double"))
    g = f.groupBy("clip_id", "run_id").agg(F.percentile("value", F.lit(0.5)).alias("dist"), (F.max_by("yaw", "frame_id") - F.min_by("yaw", "frame_id")).alias("turn"))
    g = g.withColumn("delta", F.abs(F.pmod(F.col("turn") + 180, F.lit(360.0)) - 180))
    return g.filter("dist > 30 and delta > 20").select("clip_id", "run_id", "delta")


_SAMPLES = "sm AS (SELECT p_size AS win, p_partkey AS sample, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS l, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS r, CASE WHEN p_partkey % 5 = 0 THEN p_name END AS bi FROM part)"


def samples(spark, d):
    p = table(spark, d, "part")
    pick = lambda m: F.when(F.col("p_partkey") % m == 0, F.col("p_name"))
    return p.select(F.col("p_size").alias("win"), F.col("p_partkey").alias("sample"), pick(2).alias("l"), pick(3).alias("r"), pick(5).alias("bi"))


@query(f"""WITH {_SAMPLES}, c AS (SELECT win, count(*) AS a, count(l) AS l, count(r) AS r, count(bi) AS bi FROM sm GROUP BY 1)
SELECT win, 'l' AS field, l AS n, l >= 2 AND l / a >= 0.4 AS keep FROM c UNION ALL SELECT win, 'r', r, r >= 2 AND r / a >= 0.4 FROM c UNION ALL SELECT win, 'bi', bi, bi >= 1 AND bi / a >= 0.25 FROM c""")
def consensus_filter(spark, d):
    return R.consensus(samples(spark, d), ["win"], "sample", {"l": (2, 0.4), "r": (2, 0.4), "bi": (1, 0.25)})


@query(f"""WITH {_SAMPLES}, f AS (SELECT win, sample, l, len(string_split(l, ' ')) AS n_phrases, count(*) OVER (PARTITION BY win, l) AS freq FROM sm WHERE l IS NOT NULL)
SELECT win, sample, l AS text FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY n_phrases DESC, freq DESC, sample) AS r FROM f) WHERE r = 1""")
def coverage_select(spark, d):
    s = samples(spark, d).filter("l is not null").withColumn("n_phrases", F.size(F.split("l", " "))).withColumn("freq", F.count(F.lit(1)).over(Window.partitionBy("win", "l")))
    return S.first_of(s, ["win"], F.desc("n_phrases"), F.desc("freq"), F.col("sample")).select("win", "sample", F.col("l").alias("text"))


@query(f"WITH {_SAMPLES} SELECT CAST((l IS NOT NULL)::INT + (r IS NOT NULL)::INT + (bi IS NOT NULL)::INT AS INTEGER) AS n_active, count(*) AS n FROM sm GROUP BY 1")
def action_count_dist(spark, d):
    active = sum((F.col(c).isNotNull().cast("int") for c in ("l", "r", "bi")), F.lit(0))
    return samples(spark, d).groupBy(active.alias("n_active")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT event_type AS reason, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events)
SELECT reason, count(*) AS n, string_agg(event_id, '|' ORDER BY event_id) FILTER (WHERE k <= 3) AS examples FROM r GROUP BY 1""")
def rejection_summary(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("reason"), "event_id", F.col("event_id").cast("string").alias("text"))
    return R.examples(e, "reason", "event_id", "text")


@query("SELECT round(var_pop(value), 6) AS var, event_type FROM events GROUP BY 2")
def sharpness_variance(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.var_pop("value"), 6).alias("var"))
