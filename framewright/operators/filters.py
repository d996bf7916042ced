"""Filters and predicates on rows, nested detections, boxes and segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def above(df: DataFrame, column: str, limit: float) -> DataFrame:
    return df.filter(F.col(column) > limit)


def is_box(h: Column) -> Column:
    """All corners finite and both sides positive."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return finite(h["x1"]) & finite(h["y1"]) & finite(h["x2"]) & finite(h["y2"]) & (h["x2"] > h["x1"]) & (h["y2"] > h["y1"])


def valid_boxes(df: DataFrame, hands: str = "hands") -> DataFrame:
    """Without invalid boxes, and without rows that have none left."""
    return df.withColumn(hands, F.filter(hands, is_box)).filter(F.size(hands) > 0)


def contact(df: DataFrame, pose_ok: Column, has: Callable[[Column], Column], hands: str = "hands") -> DataFrame:
    """Rows with a pose and a hand that has key points."""
    return df.filter(pose_ok & F.exists(hands, has))


def hand_of(hands: str, side: int, has: Callable[[Column], Column] | None = None) -> Column:
    """The first hand of a side (null if there is none)."""
    return F.get(F.filter(hands, lambda h: (h["side"] == side) & (has(h) if has else F.lit(True))), 0)


def length_between(df: DataFrame, key: list[str], least: int, most: int) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(least, most))


def render_gate(df: DataFrame, key: list[str], order: str, language: str, valid: str) -> DataFrame:
    """Groups whose first row has a language and whose rows are all valid (null is not)."""
    g = df.groupBy(*key).agg(F.min_by(F.struct(F.col(language).alias("l")), order).alias("f"), F.bool_and(F.coalesce(valid, F.lit(False))).alias("ok"))
    return g.filter("ok and f.l is not null").select(*key, F.col("f.l").alias("language"))


def dense(df: DataFrame, key: list[str], frame: str) -> DataFrame:
    """Whether a group's frames are consecutive without repeats."""
    n = F.count(F.lit(1))
    return df.groupBy(*key).agg(((F.max(frame) - F.min(frame) + 1 == n) & (F.count_distinct(frame) == n)).alias("dense"))


def only(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns that exist, in the list's order."""
    return df.select(*[c for c in columns if c in df.columns])


def nulled(df: DataFrame, hands: str, field: str) -> DataFrame:
    """Array of structs with one field set to null."""
    kind = df.schema[hands].dataType.elementType[field].dataType
    return df.withColumn(hands, F.transform(hands, lambda h: h.withField(field, F.lit(None).cast(kind))))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Number of rows that break each rule, and of all rows."""
    return df.agg(*[F.count_if(c).alias(k) for k, c in rules.items()], F.count(F.lit(1)).alias("n"))


def with_fallback(df: DataFrame, sources: dict[str, str], out: str, provenance: str) -> DataFrame:
    """First non-null source column, and which one it was."""
    name = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(k)) for k, c in sources.items()])
    return df.withColumn(out, F.coalesce(*map(F.col, sources.values()))).withColumn(provenance, name)


def finite(df: DataFrame, vector: str, size: int) -> DataFrame:
    """Rows whose vector has the size and only finite numbers."""
    return df.filter((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def range_check(df: DataFrame, limits: DataFrame, name: str, value: str, edge: float = 1e-6) -> DataFrame:
    """For each name: rows, rows of unknown names, rows outside the limits, rows on a limit."""
    j = df.join(limits, df[name] == limits["name"], "left")
    return j.groupBy(name).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("lo").isNull()).alias("n_unknown"),
        F.count_if(~F.col(value).between(F.col("lo"), F.col("hi"))).alias("n_outside"),
        F.count_if(F.least(F.abs(F.col(value) - F.col("lo")), F.abs(F.col(value) - F.col("hi"))) < edge).alias("n_edge"),
    )


def default_fill(df: DataFrame, key: list[str], valid: Column, value: str, default: float, out: str) -> DataFrame:
    """The default for groups without any valid row."""
    return df.withColumn(out, F.when(F.bool_or(valid).over(Window.partitionBy(*key)), F.col(value)).otherwise(default))


def outside_share(x1: str, y1: str, x2: str, y2: str, width: float, height: float) -> Column:
    """Share of a box's area that lies outside the image."""
    inside = F.greatest(F.lit(0.0), F.least(F.col(x2), F.lit(float(width))) - F.greatest(F.col(x1), F.lit(0.0))) * F.greatest(F.lit(0.0), F.least(F.col(y2), F.lit(float(height))) - F.greatest(F.col(y1), F.lit(0.0)))
    return 1 - inside / ((F.col(x2) - F.col(x1)) * (F.col(y2) - F.col(y1)))


def valid_intrinsics(fx: str, fy: str, cx: str, cy: str, xi: str, w: str, h: str, norm: Column | None = None) -> Column:
    """Plausible camera: positive focal lengths, principal point within 30 % of the centre, relative focal length in
    [0.1, 8], aspect in [1/3, 3], xi in [-0.01, 3.5]."""
    c = {k: F.col(v) for k, v in {"fx": fx, "fy": fy, "cx": cx, "cy": cy, "xi": xi, "w": w, "h": h}.items()}
    size = norm if norm is not None else F.greatest(c["w"], c["h"])
    known = c["fx"].isNotNull()
    for k in ("fx", "fy", "cx", "cy", "xi"):
        known = known & ~F.isnan(c[k]) & (F.abs(c[k]) < float("inf"))
    ok = known & (c["fx"] > 0) & (c["fy"] > 0) & (F.abs(c["cx"] - c["w"] / 2) / c["w"] <= 0.30) & (F.abs(c["cy"] - c["h"] / 2) / c["h"] <= 0.30)
    return ok & ((c["fx"] + c["fy"]) / 2 / size).between(0.1, 8.0) & F.try_divide(c["fx"], c["fy"]).between(1 / 3, 3.0) & c["xi"].between(-0.01, 3.5)


def crowd_gate(df: DataFrame, key: list[str], frame: str, count: str, stride: int = 8, people: int = 3, frames: int = 2) -> DataFrame:
    """Groups in which fewer than `frames` of the frames divisible by stride show at least `people`."""
    s = df.filter(F.pmod(frame, F.lit(stride)) == 0)
    return s.groupBy(*key).agg(F.count_if(F.col(count) >= people).alias("_c")).filter(F.col("_c") < frames).select(*key)


def drift_filter(df: DataFrame, key: list[str], frame: str, position: str, limit: float) -> DataFrame:
    """Groups whose last known position is within `limit` of the first; fewer than two positions pass."""
    p = F.col(position)
    g = df.filter(p.isNotNull()).groupBy(*key).agg(F.min_by(position, frame).alias("_a"), F.max_by(position, frame).alias("_b"), F.count(F.lit(1)).alias("_c"))
    d = F.sqrt(F.aggregate(F.zip_with("_a", "_b", lambda a, b: (b - a) * (b - a)), F.lit(0.0), lambda s, x: s + x))
    return g.filter((F.col("_c") < 2) | (d <= limit)).select(*key)
