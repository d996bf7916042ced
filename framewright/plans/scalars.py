"""Queries of the scalar and geometry functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import geometry as G
from framewright.plans.registry import query
from framewright.sources.adapters import table, vectors

_V = "v AS (SELECT label AS clip_id, vec_id AS frame_id, embedding::DOUBLE[] AS v FROM embeddings)"
_POSE = "p AS (SELECT *, [v[1], v[2], v[3], v[4]] AS r0, [v[5], v[6], v[7], v[8]] AS r1, [v[9], v[10], v[11], v[12]] AS r2 FROM v)"


def _r(c, n=6):
    # adding 0.0 turns a negative zero into zero
    return F.round(c, n) + F.lit(0.0)


def _pose(v):
    return G.matrix(F.col("v"), 3, 4) + [[F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]]


@query(f"WITH {_V} SELECT frame_id, round(500 * v[1] / (v[3] + 2) + 320, 6) + 0.0::DOUBLE AS u, round(500 * v[2] / (v[3] + 2) + 240, 6) + 0.0::DOUBLE AS w FROM v")
def pinhole_project(spark, d):
    v = F.col("v")
    u, w = G.projected([G.at(v, 0), G.at(v, 1), G.at(v, 2) + 2], F.lit(500.0), F.lit(500.0), F.lit(320.0), F.lit(240.0))
    return vectors(spark, d).select("frame_id", _r(u).alias("u"), _r(w).alias("w"))


_X = [f"r{i}[1] * v[13] + r{i}[2] * v[14] + r{i}[3] * v[15] + r{i}[4]" for i in range(3)]


@query(f"WITH {_V}, {_POSE} SELECT frame_id, {', '.join(f'round({x}, 6) + 0.0::DOUBLE AS {n}' for x, n in zip(_X, 'xyz', strict=True))} FROM p")
def rigid_transform(spark, d):
    v = F.col("v")
    pose = _pose(v)
    out = G.moved([r[:3] for r in pose[:3]], [r[3] for r in pose[:3]], [G.at(v, 12), G.at(v, 13), G.at(v, 14)])
    return vectors(spark, d).select("frame_id", *[_r(c).alias(n) for c, n in zip(out, "xyz", strict=True)])


@query(f"WITH {_V}, {_POSE} SELECT frame_id, round(r1[1], 6) + 0.0::DOUBLE AS r01, {', '.join(f'round(-(r0[{i}] * r0[4] + r1[{i}] * r1[4] + r2[{i}] * r2[4]), 6) + 0.0::DOUBLE AS t{i - 1}' for i in (1, 2, 3))} FROM p")
def se3_inverse(spark, d):
    m = G.inverse_se3(_pose(F.col("v")))
    return vectors(spark, d).select("frame_id", _r(m[0][1]).alias("r01"), *[_r(m[i][3]).alias(f"t{i}") for i in range(3)])


@query(f"WITH {_V} SELECT frame_id, CAST(i - 1 AS INTEGER) AS i, round(list_extract([v[4], v[8], v[12], v[1], v[2], v[3], v[5], v[6], v[7]], i), 6) + 0.0::DOUBLE AS x FROM v, (SELECT unnest(range(1, 10)) AS i)")
def pose_xyz_rot6d(spark, d):
    return vectors(spark, d).select("frame_id", F.posexplode(F.array(*G.xyz_rot6(_pose(F.col("v"))))).alias("i", "x")).withColumn("x", _r("x"))


_TR = " + ".join(f"v[{1 + 3 * i + k}] * v[{10 + 3 * i + k}]" for i in range(3) for k in range(3))


@query(f"WITH {_V} SELECT frame_id, round(degrees(acos(greatest(-1, least(1, ({_TR} - 1) / 2)))), 6) AS angle FROM v")
def rot_error_deg(spark, d):
    v = F.col("v")
    return vectors(spark, d).select("frame_id", _r(G.rotation_angle(G.matrix(v, 3, 3), G.matrix(F.slice(v, 10, 9), 3, 3))).alias("angle"))


@query(f"WITH {_V} SELECT frame_id, CASE WHEN abs(degrees(atan2(v[1], -v[2]))) <= 45 THEN round(v[3], 6) + 0.0::DOUBLE END AS x FROM v")
def roll_null_out(spark, d):
    v = F.col("v")
    angle = G.roll([G.at(v, 0), G.at(v, 1)])
    return vectors(spark, d).select("frame_id", F.when(F.abs(angle) <= 45, _r(G.at(v, 2))).alias("x"))


@query(f"""WITH {_V}, n AS (SELECT frame_id, v[1] / l AS x, v[2] / l AS y, v[3] / l AS z FROM (SELECT *, sqrt(v[1] * v[1] + v[2] * v[2] + v[3] * v[3]) + 1e-12 AS l FROM v)),
a AS (SELECT *, CASE WHEN abs(x) > 0.9 THEN 0.0::DOUBLE ELSE 1.0 END AS rx, CASE WHEN abs(x) > 0.9 THEN 1.0::DOUBLE ELSE 0.0 END AS ry FROM n),
b AS (SELECT *, rx - (rx * x + ry * y) * x AS ax, ry - (rx * x + ry * y) * y AS ay, -(rx * x + ry * y) * z AS az FROM a),
c AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) + 1e-12 AS m FROM b)
SELECT frame_id, round(ax / m, 5) + 0.0::DOUBLE AS xx, round((y * az - z * ay) / m, 5) + 0.0::DOUBLE AS yx, round(z, 5) + 0.0::DOUBLE AS zz FROM c""")
def gravity_basis(spark, d):
    v = F.col("v")
    m = G.gravity_basis([G.at(v, 0), G.at(v, 1), G.at(v, 2)])
    return vectors(spark, d).select("frame_id", _r(m[0][0], 5).alias("xx"), _r(m[1][0], 5).alias("yx"), _r(m[2][2], 5).alias("zz"))


@query(f"WITH {_V} SELECT frame_id, round(cos(v[7]) * (v[1] - v[4]) + sin(v[7]) * (v[2] - v[5]), 6) + 0.0::DOUBLE AS x, round(cos(v[7]) * (v[2] - v[5]) - sin(v[7]) * (v[1] - v[4]), 6) + 0.0::DOUBLE AS y, round(v[3] - v[6], 6) + 0.0::DOUBLE AS z FROM v")
def yaw_transform(spark, d):
    v = F.col("v")
    out = G.yaw_moved([G.at(v, i) for i in range(3)], [G.at(v, i) for i in (3, 4, 5)], G.at(v, 6))
    return vectors(spark, d).select("frame_id", *[_r(c).alias(n) for c, n in zip(out, "xyz", strict=True)])


@query(f"WITH {_V}, k AS (SELECT frame_id, unnest(range(21)) AS i, v FROM v) SELECT frame_id, bool_and(500 * v[3 * i + 1] + 320 BETWEEN 100 AND 539.999999 AND 500 * v[3 * i + 2] + 240 BETWEEN 20 AND 459.999999) AS inside FROM k GROUP BY 1")
def kpts_in_image(spark, d):
    points = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct((500 * F.get("v", 3 * i) + 220).alias("u"), (500 * F.get("v", 3 * i + 1) + 220).alias("v")))
    return vectors(spark, d).select("frame_id", G.in_image(points, F.lit(440), F.lit(440)).alias("inside"))


@query("""WITH s AS (SELECT p_partkey, CAST(100 + p_size * 7 AS INTEGER) AS h, CAST(120 + p_partkey % 500 AS INTEGER) AS w FROM part)
SELECT p_partkey, h, w, CASE WHEN h <= w THEN 192 ELSE CAST(floor((round_even(h * 192 / w, 0) + 1) / 2.0) * 2 AS INTEGER) END AS out_h, CASE WHEN h <= w THEN CAST(floor((round_even(w * 192 / h, 0) + 1) / 2.0) * 2 AS INTEGER) ELSE 192 END AS out_w FROM s""")
def output_size(spark, d):
    p = table(spark, d, "part").select("p_partkey", (100 + F.col("p_size") * 7).cast("int").alias("h"), (120 + F.col("p_partkey") % 500).cast("int").alias("w"))
    h, w = G.output_size(F.col("h"), F.col("w"))
    return p.select("p_partkey", "h", "w", h.cast("int").alias("out_h"), w.cast("int").alias("out_w"))


@query("""WITH s AS (SELECT p_partkey, 100 + p_size * 7 AS h, 120 + p_partkey % 500 AS w FROM part), q AS (SELECT *, CAST(floor(h * sqrt(196608.0::DOUBLE / (h * w))) AS INTEGER) AS a, CAST(floor(w * sqrt(196608.0::DOUBLE / (h * w))) AS INTEGER) AS b FROM s)
SELECT p_partkey, a - a % 8 AS h, b - b % 8 AS w FROM q""")
def slam_dims(spark, d):
    p = table(spark, d, "part").select("p_partkey", (100 + F.col("p_size") * 7).alias("h"), (120 + F.col("p_partkey") % 500).alias("w"))
    h, w = G.slam_size(F.col("h"), F.col("w"))
    return p.select("p_partkey", h.alias("h"), w.alias("w"))


@query("SELECT p_partkey, round(degrees(2 * atan((120 + p_partkey % 500) / (2 * (p_size + 50)::DOUBLE))), 6) AS fov FROM part")
def fov_deg(spark, d):
    return table(spark, d, "part").select("p_partkey", _r(G.field_of_view((120 + F.col("p_partkey") % 500).cast("double"), (F.col("p_size") + 50).cast("double"))).alias("fov"))


@query(f"WITH {_V} SELECT frame_id, round(24.0::DOUBLE * 640 / (500 + v[1]), 6) AS aperture, round(-v[2], 6) + 0.0::DOUBLE AS flipped, round(v[4], 6) + 0.0::DOUBLE AS w FROM v")
def camera_params(spark, d):
    v = F.col("v")
    return vectors(spark, d).select("frame_id", _r(G.aperture(500 + G.at(v, 0), F.lit(640.0))).alias("aperture"), _r(G.flipped_axes(_pose(v))[0][1]).alias("flipped"), _r(G.at(G.wxyz(v), 0)).alias("w"))


@query(f"WITH {_V} SELECT frame_id, CAST(i - 1 AS INTEGER) AS i, round(v[i + 7], 6) + 0.0::DOUBLE AS x FROM v, (SELECT unnest(range(1, 6)) AS i)")
def joint_slice(spark, d):
    return vectors(spark, d).select("frame_id", F.posexplode(F.slice("v", 8, 5)).alias("i", "x")).withColumn("x", _r("x"))


@query(f"WITH {_V} SELECT frame_id, CAST(i - 1 AS INTEGER) AS i, round(v[i], 6) + 0.0::DOUBLE AS x FROM v, (SELECT unnest(range(1, 10)) AS i)")
def eef_truncate(spark, d):
    packed = F.concat(F.slice("v", 1, 3), F.slice("v", 4, 6), F.slice("v", 10, 15))
    return vectors(spark, d).select("frame_id", F.posexplode(G.fitted(packed, 9)).alias("i", "x")).withColumn("x", _r("x"))


@query(f"WITH {_V} SELECT frame_id, CAST(i - 1 AS INTEGER) AS i, CASE WHEN i <= 64 THEN round(v[i], 6) + 0.0::DOUBLE ELSE 0.0 END AS x FROM v, (SELECT unnest(range(60, 71)) AS i)")
def pad_truncate(spark, d):
    return vectors(spark, d).select("frame_id", F.posexplode(G.fitted(F.col("v"), 70)).alias("i", "x")).filter("i >= 59").withColumn("x", _r("x"))


@query("SELECT event_id, CAST(event_id % 300 + 1 AS BIGINT) AS h, CAST(event_id % 200 + 1 AS BIGINT) AS w, true AS ok FROM events")
def mask_header(spark, d):
    from framewright.functions import masks

    size = lambda n: F.unhex(F.lpad(F.hex(F.col("event_id") % n + 1), 8, "0"))
    m = table(spark, d, "events").select("event_id", F.concat(F.lit(b"BMK1"), size(300), size(200)).alias("m"))
    ok, h, w = masks.header(F.col("m"))
    return m.select("event_id", h.alias("h"), w.alias("w"), ok.alias("ok"))
