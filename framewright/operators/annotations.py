"""Annotated frames: columns added in place, nested updates, gates with their reasons, fallbacks, robust scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_column_in_place(df: DataFrame, values: DataFrame, key: list[str], column: str) -> DataFrame:
    """df with `column` taken from values where these have one, else as it was (null where df had none)."""
    old = F.col(column) if column in df.columns else F.lit(None).cast(values.schema[column].dataType)
    new = values.select(*key, F.col(column).alias("_new"))
    return df.join(new, key, "left").withColumn(column, F.coalesce("_new", old)).drop("_new")


def renested(frames: DataFrame, updates: DataFrame, key: list[str], items: str, fields: list[str]) -> DataFrame:
    """frames with the listed fields of each struct in `items` filled from updates (key, place, fields); places without an update keep theirs.

    Items are taken apart, joined by frame and place, and put together in their order; null and empty lists stay.
    """
    kind = frames.schema[items].dataType.elementType
    flat = frames.select(*key, F.posexplode(items).alias("place", "_item"))
    flat = flat.join(updates.select(*key, "place", *[F.col(f).alias(f"_{f}") for f in fields]), [*key, "place"], "left")
    cells = [F.coalesce(f"_{c.name}", F.col(f"_item.{c.name}")).alias(c.name) if c.name in fields else F.col(f"_item.{c.name}").alias(c.name) for c in kind.fields]
    lists = flat.select(*key, F.struct("place", F.struct(*cells).alias("x")).alias("p")).groupBy(*key).agg(F.sort_array(F.collect_list("p")).alias("_l"))
    lists = lists.select(*key, F.transform("_l", lambda p: p["x"]).alias("_new"))
    return frames.join(lists, key, "left").withColumn(items, F.coalesce(F.col("_new"), F.col(items))).drop("_new")


def judged(df: DataFrame, reasons: dict[str, Column], out: str = "reject") -> DataFrame:
    """df with the name of the first condition that holds (null: the row is kept)."""
    return df.withColumn(out, F.coalesce(*[F.when(c, F.lit(name)) for name, c in reasons.items()]))


def reject_table(df: DataFrame, out: str = "reject") -> DataFrame:
    """reason and number of rows, kept ones under "kept": the book of what a step dropped."""
    return df.groupBy(F.coalesce(out, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def first_rejection(df: DataFrame, key: list[str], order: str, visual: Column, text: Column) -> DataFrame:
    """key and code of the groups that any row rejects: the first visual code in order, else the first text code."""
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col(order)))
    return df.groupBy(*key).agg(F.coalesce(first(visual), first(text)).alias("code")).filter("code is not null")


def side_claims(df: DataFrame, frame: list[str], side: str, conf: str, order: list[Column], cap: float = 0.49) -> DataFrame:
    """df with `conf` of all but the first claimant of a side in a frame at most `cap`."""
    place = F.row_number().over(Window.partitionBy(*frame, side).orderBy(*order))
    return df.withColumn("_r", place).withColumn(conf, F.when(F.col("_r") > 1, F.least(F.col(conf), F.lit(cap))).otherwise(F.col(conf))).drop("_r")


def square(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int, dilate: float = 1.2) -> Column:
    """Pixel bounds (rx1, ry1, rx2, ry2) of the dilated square around a box, cut to the image; what stands in for a missing mask."""
    half = F.greatest(x2 - x1, y2 - y1) * dilate * 0.5
    mid = lambda a, b: a + (b - a) * 0.5
    low = lambda m: F.greatest(F.lit(0), (m - half).cast("int"))
    high = lambda m, n: F.least(F.lit(n), (m + half).cast("int"))
    x, y = mid(x1, x2), mid(y1, y2)
    return F.struct(low(x).alias("rx1"), low(y).alias("ry1"), high(x, width).alias("rx2"), high(y, height).alias("ry2"))


def median_of_several(column: Column, least: int = 3) -> Column:
    """Median, NaN for fewer than `least` values."""
    return F.when(F.count(column) < least, F.lit(float("nan"))).otherwise(F.percentile(column, F.lit(0.5)))


def distance_scale(df: DataFrame, key: list[str], t: str, source: list[str], target: list[str], low: float = 0.5, high: float = 2.0) -> DataFrame:
    """key and scale: median ratio of the distances of point pairs in target and source, 1 outside [low, high] or without a ratio.

    Pairs are those of one window, whose length bounds them.
    """
    cols = list(dict.fromkeys((t, *source, *target)))
    a = df.select(*key, *cols)
    b = a.select(*key, *[F.col(c).alias(f"{c}_2") for c in cols])
    apart = lambda cs: F.sqrt(sum(((F.col(c) - F.col(f"{c}_2")) ** 2 for c in cs), F.lit(0.0)))
    p = a.join(b, key).filter(F.col(t) < F.col(f"{t}_2")).withColumn("_r", F.when(apart(source) > 1e-9, apart(target) / apart(source)))
    m = p.groupBy(*key).agg(F.percentile("_r", F.lit(0.5)).alias("_m"))
    m = df.select(*key).distinct().join(m, key, "left")
    return m.select(*key, F.when(F.col("_m").between(low, high), F.col("_m")).otherwise(1.0).alias("scale"))
