"""Queries of the window and sequence operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.operators import sequences as S
from framewright.plans.registry import DET, EP, FRAMES, LONG, RUNS, query
from framewright.sources.adapters import detections, episodes, frames, frames_long

KEY = ["clip_id"]


@query(f"WITH {FRAMES}, {RUNS} SELECT clip_id, run_id, start_frame, end_frame, n_frames, end_frame - start_frame + 1 AS span FROM runs WHERE end_frame - start_frame + 1 >= 16")
def gap_sessions(spark, d):
    return S.gap_sessions(frames(spark, d), KEY, gap_fill=3, min_span=16)


def _windows_sql(source: str, length: int, stride: int) -> str:
    return f"""WITH {source}, {RUNS}, l AS (SELECT *, greatest(start_frame, end_frame - {length - 1}) AS last FROM runs),
w AS (SELECT clip_id, run_id, end_frame, unnest(list_distinct(list_append(range(start_frame, last + 1, {stride}), last))) AS w_start FROM l)
SELECT clip_id, run_id, CAST(w_start AS INTEGER) AS w_start, CAST(least(w_start + {length - 1}, end_frame) AS INTEGER) AS w_end FROM w"""


def _windows(df, length, stride):
    return S.sliding_windows(S.gap_sessions(df, KEY), length, stride).select("clip_id", "run_id", "w_start", "w_end")


@query(_windows_sql(LONG, 210, 105))
def sliding_windows(spark, d):
    return _windows(frames_long(spark, d), 210, 105)


@query(_windows_sql(LONG, 600, 450))
def sliding_windows_600(spark, d):
    return _windows(frames_long(spark, d), 600, 450)


@query(_windows_sql(LONG, 200, 188))
def sliding_windows_200(spark, d):
    return _windows(frames_long(spark, d), 200, 188)


@query(_windows_sql(LONG, 720, 630))
def sliding_windows_720(spark, d):
    return _windows(frames_long(spark, d), 720, 630)


@query(f"""WITH {LONG}, {RUNS}, o AS (SELECT clip_id, run_id, frame_id, row_number() OVER (PARTITION BY clip_id, run_id ORDER BY frame_id) - 1 AS i, count(*) OVER (PARTITION BY clip_id, run_id) AS n, lead(frame_id, 15) OVER (PARTITION BY clip_id, run_id ORDER BY frame_id) AS e FROM s)
SELECT clip_id, run_id, frame_id AS w_start, e AS w_end FROM o WHERE n >= 16 AND e - frame_id <= 18 AND (i % 12 = 0 OR i = n - 16)""")
def count_windows(spark, d):
    return S.count_windows(frames_long(spark, d), KEY)


@query(f"""WITH {LONG}, o AS (SELECT *, CAST((row_number() OVER (PARTITION BY clip_id ORDER BY frame_id) - 1) // 60 AS INTEGER) AS block FROM fr WHERE value > 40)
SELECT clip_id, block, min(frame_id) AS w_start, max(frame_id) + 1 AS w_end, count(*) AS n_moving FROM o GROUP BY 1, 2 HAVING count(*) >= 30""")
def motion_windows(spark, d):
    return S.every_nth_block(frames_long(spark, d).filter("value > 40"), KEY, "frame_id", 60, 30)


@query(f"""WITH {FRAMES}, o AS (SELECT clip_id, frame_id, row_number() OVER (PARTITION BY clip_id ORDER BY frame_id) - 1 AS i, count(*) OVER (PARTITION BY clip_id) AS n FROM fr)
SELECT clip_id, frame_id FROM o WHERE n <= 20 OR list_contains([CAST(floor(k * (n - 1) / 19.0::DOUBLE) AS BIGINT) FOR k IN range(20)], i)""")
def uniform_subsample(spark, d):
    return S.uniform_pick(frames(spark, d), KEY, "frame_id", 20).select("clip_id", "frame_id")


@query(f"""WITH RECURSIVE {FRAMES}, t AS (SELECT clip_id, min(frame_id) AS frame_id FROM fr GROUP BY 1 UNION ALL
SELECT t.clip_id, (SELECT min(frame_id) FROM fr WHERE fr.clip_id = t.clip_id AND fr.frame_id >= t.frame_id + 5) FROM t WHERE t.frame_id IS NOT NULL)
SELECT clip_id, frame_id FROM t WHERE frame_id IS NOT NULL""")
def min_gap_thin(spark, d):
    return S.thinned(frames(spark, d), KEY, "frame_id", 5)


@query(f"WITH {FRAMES} SELECT clip_id, frame_id, event_id FROM fr WHERE frame_id % 8 = 0")
def stride_sample(spark, d):
    return frames(spark, d).filter(F.pmod("frame_id", F.lit(8)) == 0).select("clip_id", "frame_id", "event_id")


@query(f"""WITH {FRAMES}, {RUNS} SELECT clip_id, run_id, min(frame_id) FILTER (WHERE value >= 20) AS trim_start, max(frame_id) FILTER (WHERE value >= 20) AS trim_end,
count(*) FILTER (WHERE value >= 20) AS n_valid FROM s GROUP BY 1, 2 HAVING count(*) FILTER (WHERE value >= 20) > 0""")
def trim_dead_zones(spark, d):
    valid = F.when(F.col("value") >= 20, F.col("frame_id"))
    return S.run_ids(frames(spark, d), KEY).groupBy("clip_id", "run_id").agg(F.min(valid).alias("trim_start"), F.max(valid).alias("trim_end"), F.count(valid).alias("n_valid")).filter("n_valid > 0")


@query(f"WITH {FRAMES}, {RUNS} SELECT clip_id, run_id, event_id, frame_id - min(frame_id) OVER (PARTITION BY clip_id, run_id) AS frame_id FROM s")
def rezero_frames(spark, d):
    f = S.run_ids(frames(spark, d), KEY)
    return f.select("clip_id", "run_id", "event_id", (F.col("frame_id") - F.min("frame_id").over(Window.partitionBy("clip_id", "run_id"))).alias("frame_id"))


@query(f"""WITH {FRAMES}, {RUNS}, w AS (SELECT clip_id, run_id, unnest(range(start_frame, end_frame + 1)) AS frame_id FROM runs)
SELECT w.clip_id, w.run_id, CAST(w.frame_id AS INTEGER) AS frame_id, s.event_id, s.event_id IS NULL AS gap FROM w LEFT JOIN s ON w.clip_id = s.clip_id AND w.run_id = s.run_id AND w.frame_id = s.frame_id""")
def densify_gap_rows(spark, d):
    return S.densified(S.run_ids(frames(spark, d), KEY).select("clip_id", "run_id", "frame_id", "event_id"), ["clip_id", "run_id"], "frame_id", [])


@query(f"WITH {EP} SELECT episode, t, l_quantity AS state, coalesce(lead(l_quantity) OVER (PARTITION BY episode ORDER BY t), l_quantity) AS action FROM ep")
def next_frame_action(spark, d):
    return S.next_value(episodes(spark, d).withColumnRenamed("l_quantity", "state"), ["episode"], "t", "state", "action").select("episode", "t", "state", "action")


_SPARSE = "v AS (SELECT clip_id, frame_id, CASE WHEN event_id % 3 = 0 THEN value END AS x FROM fr)"
_NEAR = """p AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN frame_id END IGNORE NULLS) OVER b AS pf, last_value(x IGNORE NULLS) OVER b AS pv,
first_value(CASE WHEN x IS NOT NULL THEN frame_id END IGNORE NULLS) OVER a AS nf, first_value(x IGNORE NULLS) OVER a AS nv FROM v
WINDOW b AS (PARTITION BY clip_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY clip_id ORDER BY frame_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _sparse(spark, d):
    return frames(spark, d).select("clip_id", "frame_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("x"))


@query(f"WITH {FRAMES}, {_SPARSE}, {_NEAR} SELECT clip_id, frame_id, round(coalesce(x, pv + (nv - pv) * ((frame_id - pf) / nullif(nf - pf, 0)), pv, nv, 0.0), 6) AS filled FROM p")
def fill_missing(spark, d):
    return S.filled(_sparse(spark, d), KEY, "frame_id", "x", "filled").select("clip_id", "frame_id", F.round("filled", 6).alias("filled"))


@query(f"WITH {FRAMES}, {_SPARSE}, {_NEAR} SELECT clip_id, frame_id, pf AS prev_frame, pv AS prev_value, nf AS next_frame, nv AS next_value FROM p")
def asof_prev_next(spark, d):
    return S.neighbours(_sparse(spark, d), KEY, "frame_id", "x").drop("x")


@query(f"""WITH {FRAMES}, {_SPARSE}, {_NEAR} SELECT clip_id, frame_id, round(coalesce(x, CASE WHEN nf - pf - 1 <= 3 THEN pv + (nv - pv) * ((frame_id - pf) / nullif(nf - pf, 0)) END), 6) AS filled,
x IS NULL AND coalesce(nf - pf - 1 > 3, true) AS broken FROM p""")
def bounded_interp_breaks(spark, d):
    out = S.filled(_sparse(spark, d), KEY, "frame_id", "x", "filled", longest=3)
    return out.select("clip_id", "frame_id", F.round("filled", 6).alias("filled"), (F.col("x").isNull() & F.coalesce(F.col("next_frame") - F.col("prev_frame") - 1 > 3, F.lit(True))).alias("broken"))


def _terms(kernel, weight=None):
    top, low = [], []
    for i, k in enumerate(kernel):
        o = i - len(kernel) // 2
        at = lambda c: c if o == 0 else f"{'lead' if o > 0 else 'lag'}({c}, {abs(o)}) OVER w"  # noqa: B023, E731
        s = f"coalesce({at(weight)}, 0)" if weight else "1"
        top.append(f"coalesce({at('value')} * {s} * {k!r}::DOUBLE, 0)")
        low.append(f"CASE WHEN {at('value')} IS NULL THEN 0 ELSE {s} * {k!r}::DOUBLE END")
    return " + ".join(top), " + ".join(low)


_G13 = S.gaussian(13, 2.0)
_TOP, _LOW = _terms(_G13)


@query(f"""WITH {LONG}, {RUNS} SELECT clip_id, frame_id, round(CASE WHEN count(*) OVER (PARTITION BY clip_id, run_id) < 13 THEN value ELSE ({_TOP}) / ({_LOW}) END, 6) AS smooth
FROM s WINDOW w AS (PARTITION BY clip_id, run_id ORDER BY frame_id)""")
def gaussian_smooth(spark, d):
    f = S.run_ids(frames_long(spark, d), KEY).withColumn("n_run", F.count(F.lit(1)).over(Window.partitionBy("clip_id", "run_id")))
    f = S.smoothed(f, ["clip_id", "run_id"], "frame_id", "value", _G13, "smooth")
    return f.select("clip_id", "frame_id", F.round(F.when(F.col("n_run") < 13, F.col("value")).otherwise(F.col("smooth")), 6).alias("smooth"))


_G9 = S.gaussian(9, 1.0)
_VTOP, _VLOW = _terms(_G9, "ok")


@query(f"""WITH {LONG}, q AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 1.0 END AS ok FROM fr)
SELECT clip_id, frame_id, round(CASE WHEN ({_VLOW}) < 0.1 THEN value ELSE ({_VTOP}) / ({_VLOW}) END, 6) AS smooth FROM q WINDOW w AS (PARTITION BY clip_id ORDER BY frame_id)""")
def validity_smooth(spark, d):
    f = frames_long(spark, d).withColumn("ok", F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(1.0))
    f = S.smoothed(f, KEY, "frame_id", "value", _G9, "smooth", weight="ok", floor=0.1)
    return f.select("clip_id", "frame_id", F.round("smooth", 6).alias("smooth"))


@query(f"""WITH {FRAMES}, q AS (SELECT clip_id, frame_id, coalesce(abs(value - lag(value) OVER w) * 30, 0) AS v, coalesce(abs(lead(value) OVER w - 2 * value + lag(value) OVER w) * 30, 0) AS a FROM fr WINDOW w AS (PARTITION BY clip_id ORDER BY frame_id))
SELECT clip_id, frame_id, round(greatest(exp(-pow(greatest(v, a) / 2000.0, 4)), 0.01), 6) AS weight FROM q""")
def speed_outlier_weight(spark, d):
    return S.speed_weights(frames(spark, d), KEY, "frame_id", "value", 2000.0, 30.0, "weight").select("clip_id", "frame_id", F.round("weight", 6).alias("weight"))


@query(f"""WITH {EP}, q AS (SELECT episode, t, lead(l_quantity) OVER w - 2 * l_quantity + lag(l_quantity) OVER w AS x, count(*) OVER (PARTITION BY episode) AS n FROM ep WINDOW w AS (PARTITION BY episode ORDER BY t))
SELECT episode, t, CASE WHEN n <= 2 THEN 0.0 ELSE coalesce(x, lead(x) OVER w, lag(x) OVER w) END AS ddq FROM q WINDOW w AS (PARTITION BY episode ORDER BY t)""")
def second_difference(spark, d):
    return S.second_difference(episodes(spark, d), ["episode"], "t", "l_quantity", "ddq").select("episode", "t", "ddq")


@query(f"""WITH {FRAMES}, q AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY value DESC, frame_id) AS r, count(*) OVER (PARTITION BY clip_id) AS c FROM fr)
SELECT clip_id, frame_id FROM q WHERE r <= greatest(CAST(floor(c * 0.3::DOUBLE) AS BIGINT), least(50, c))""")
def top_ratio(spark, d):
    return S.top_share(frames(spark, d), KEY, "value", "frame_id", 0.3, 50).select("clip_id", "frame_id")


@query(f"""WITH RECURSIVE {FRAMES}, {RUNS}, t AS (SELECT clip_id, run_id, start_frame AS frame_id, start_frame + 15 AS nxt FROM runs UNION ALL
SELECT t.clip_id, t.run_id, (SELECT min(frame_id) FROM s WHERE s.clip_id = t.clip_id AND s.run_id = t.run_id AND s.frame_id >= t.nxt), t.nxt + 15 FROM t WHERE t.frame_id IS NOT NULL),
u AS (SELECT * FROM t WHERE frame_id IS NOT NULL) SELECT DISTINCT clip_id, run_id, CAST(frame_id AS BIGINT) AS frame_id FROM u""")
def waypoints(spark, d):
    return S.waypoints(S.run_ids(frames(spark, d), KEY), ["clip_id", "run_id"], "frame_id", 15)


@query(f"""WITH {LONG}, {RUNS}, m AS (SELECT *, max(end_frame) OVER (PARTITION BY clip_id ORDER BY start_frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS guard FROM runs)
SELECT s.clip_id, s.run_id, s.frame_id FROM s JOIN m ON s.clip_id = m.clip_id AND s.run_id = m.run_id WHERE m.guard IS NULL OR s.frame_id >= m.guard + 7""")
def chain_guard(spark, d):
    f = S.run_ids(frames_long(spark, d), KEY)
    runs = S.gap_sessions(frames_long(spark, d), KEY)
    guard = F.max("end_frame").over(Window.partitionBy("clip_id").orderBy("start_frame").rowsBetween(Window.unboundedPreceding, -1))
    return f.join(runs.withColumn("guard", guard).select("clip_id", "run_id", "guard"), ["clip_id", "run_id"]).filter("guard is null or frame_id >= guard + 7").select("clip_id", "run_id", "frame_id")


@query(f"""WITH {DET}, q AS (SELECT *, least(x1, y1, 640 - x2, 480 - y2) AS edge FROM det), r AS (SELECT *, row_number() OVER (PARTITION BY clip_id, side ORDER BY edge DESC, frame_id, hand_idx) AS r FROM q)
SELECT clip_id, side, frame_id, edge FROM r WHERE r = 1""")
def seed_frame(spark, d):
    q = detections(spark, d).withColumn("edge", F.least("x1", "y1", 640 - F.col("x2"), 480 - F.col("y2")))
    return S.first_of(q, ["clip_id", "side"], F.desc("edge"), F.col("frame_id"), F.col("hand_idx")).select("clip_id", "side", "frame_id", "edge")


@query(f"WITH {EP}, q AS (SELECT episode, t, abs(l_quantity - lag(l_quantity) OVER (PARTITION BY episode ORDER BY t)) AS dist FROM ep) SELECT episode, t, dist FROM q WHERE dist < 10")
def neighbour_gap(spark, d):
    e = episodes(spark, d).withColumn("dist", F.abs(F.col("l_quantity") - F.lag("l_quantity").over(S.by(["episode"], "t"))))
    return e.filter("dist < 10").select("episode", "t", "dist")


@query(f"WITH {EP}, q AS (SELECT episode, t, bool_and(l_discount < 0.09) OVER (PARTITION BY episode ORDER BY t ROWS UNBOUNDED PRECEDING) AS ok FROM ep) SELECT episode, t FROM q WHERE ok")
def prefix_survivors(spark, d):
    e = episodes(spark, d).withColumn("ok", F.bool_and(F.col("l_discount") < 0.09).over(S.by(["episode"], "t").rowsBetween(Window.unboundedPreceding, 0)))
    return e.filter("ok").select("episode", "t")
