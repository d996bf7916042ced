"""Aggregates: votes, robust medians, circular means, thresholds, consensus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE has it: by zero NaN or an infinity, where Spark's division would stop."""
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(math.nan)).otherwise(F.signum(a) * math.inf)
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def side_vote(df: DataFrame, key: list[str], side: str, side_conf: str, weight: str) -> DataFrame:
    """Weighted mean probability of the right side, the side it gives (0 left, 1 right) and the confidence in it.

    Weights that are all zero give NaN, which counts as right and as the largest number.
    """
    p = F.when(F.col(side) == 1, F.col(side_conf)).otherwise(1 - F.col(side_conf))
    g = df.groupBy(*key).agg(quotient(F.sum(p * F.col(weight)), F.sum(weight)).alias("p_right"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("side", (F.col("p_right") >= 0.5).cast("int")).withColumn("side_conf", F.greatest("p_right", 1 - F.col("p_right")))


def mad_median(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Median of each column over the rows that lie within some robust deviations of it in every column.

    Fewer than 5 rows: the plain median. Deviation: 1.4826 times the median absolute deviation, at
    least 1e-8. Limit: 4.0 for up to 6 rows, 3.5 for up to 9, else 3.0. Nothing left: plain median.
    """
    med = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), *[F.percentile(c, F.lit(0.5)).alias(f"m_{c}") for c in columns])
    j = df.select(*key, *columns).join(med, key)
    mad = j.groupBy(*key).agg(*[F.percentile(F.abs(F.col(c) - F.col(f"m_{c}")), F.lit(0.5)).alias(f"d_{c}") for c in columns])
    j = j.join(mad, key)
    limit = F.when(F.col("n") <= 6, 4.0).when(F.col("n") <= 9, 3.5).otherwise(3.0)
    ok = F.lit(True)
    for c in columns:
        ok = ok & (F.abs(F.col(c) - F.col(f"m_{c}")) <= limit * F.greatest(F.col(f"d_{c}") * 1.4826, F.lit(1e-8)))
    ok = ok | (F.col("n") < 5)
    g = j.groupBy(*key).agg(F.max("n").alias("n"), *[F.coalesce(F.percentile(F.when(ok, F.col(c)), F.lit(0.5)), F.max(f"m_{c}")).alias(c) for c in columns])
    return g


def stable_median(df: DataFrame, key: list[str], order: str, value: str, last: int = 3, tolerance: float = 0.1) -> DataFrame:
    """Median of the values near the median of the last few; null unless at least `last` are near it, then near their median."""
    d = df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order))))
    ref = d.filter(F.col("_r") <= last).groupBy(*key).agg(F.percentile(value, F.lit(0.5)).alias("_ref"))
    near = lambda c: F.abs(F.col(value) - F.col(c)) <= tolerance * F.abs(F.col(c))
    d = d.join(ref, key)
    once = d.groupBy(*key).agg(F.percentile(F.when(near("_ref"), F.col(value)), F.lit(0.5)).alias("_med"), F.count_if(near("_ref")).alias("_n"))
    d = d.join(once.filter(F.col("_n") >= last).select(*key, "_med"), key, "left")
    g = d.groupBy(*key).agg(F.max("_med").alias("_med"), F.count_if(near("_med")).alias("n_near"))
    return g.select(*key, F.when(F.col("n_near") >= last, F.col("_med")).alias("estimate"), "n_near")


def circular_mean(df: DataFrame, key: list[str], x: str, y: str, weight: str, least: float = 0.05) -> DataFrame:
    """Direction in degrees of the weighted unit vectors of length over `least`; without any, of the longest one."""
    norm = F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    d = df.withColumn("_n", norm).withColumn("_w", F.when(F.col("_n") > least, F.col(weight) / F.col("_n")))
    g = d.groupBy(*key).agg(F.sum(F.col("_w") * F.col(y)).alias("_s"), F.sum(F.col("_w") * F.col(x)).alias("_c"), F.max_by(F.struct(x, y), F.struct("_n", x, y)).alias("_l"))
    return g.select(*key, F.degrees(F.atan2(F.coalesce("_s", F.col(f"_l.{y}")), F.coalesce("_c", F.col(f"_l.{x}")))).alias("angle"))


def thresholds(df: DataFrame, columns: dict[str, float]) -> DataFrame:
    """One row: the percentile of each column (linear between ranks; null and NaN left out)."""
    return df.agg(*[F.percentile(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(p)).alias(c) for c, p in columns.items()])


def within_thresholds(df: DataFrame, columns: dict[str, float], least: int = 100) -> DataFrame:
    """Rows none of whose columns is above its threshold; null and NaN pass; with fewer than `least` rows all pass."""
    t = thresholds(df, columns).select(*[F.col(c).alias(f"t_{c}") for c in columns]).crossJoin(df.agg(F.count(F.lit(1)).alias("_all")))
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")) > F.col(f"t_{c}"), F.lit(False))
    # the threshold table has one row
    return df.join(F.broadcast(t)).filter((F.col("_all") < least) | ~bad).select(*df.columns)


def nan_mean(column: str) -> Column:
    """Mean of a numeric column without NaN; NaN if nothing is left."""
    return F.coalesce(F.avg(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))), F.lit(math.nan))


def ordered_means(df: DataFrame, key: list[str], order: str, columns: list[str], length: str) -> DataFrame:
    """nan_mean of each column, summed in order, and the number of rows.

    A sum of doubles depends on the order of its terms, and means that agree but for the last bit
    fall on both sides of a percentile; in a fixed order every run and every partitioning agree.
    """
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = df.select(*key, order, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    d = d.select(*key, F.row_number().over(Window.partitionBy(*key).orderBy(order)).alias("_r"), *[f(c).over(w).alias(f"_{x}_{c}") for c in columns for f, x in ((F.sum, "s"), (F.count, "n"))])
    last = F.max(F.struct("_r", *[f"_{x}_{c}" for c in columns for x in "sn"])).alias("_x")
    mean = lambda c: F.coalesce(F.try_divide(F.col(f"_x._s_{c}"), F.col(f"_x._n_{c}")), F.lit(math.nan))
    return d.groupBy(*key).agg(last).select(*key, *[mean(c).alias(c) for c in columns], F.col("_x._r").cast("long").alias(length))


def array_means(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """nan_mean over all elements of list columns."""
    out = df.select(*key).distinct()
    for c in columns:
        out = out.join(df.select(*key, F.explode(c).alias(c)).groupBy(*key).agg(nan_mean(c).alias(c)), key, "left")
    return out


def cosine_blend(df: DataFrame, key: list[str], place: str, size: str, value: str) -> DataFrame:
    """Mean weighted by a raised cosine over each window, at least 1e-6."""
    half = F.col(size) / 2
    w = F.greatest(0.5 * (1 + F.cos(math.pi * (F.col(place) - (F.col(size) - 1) / 2) / half)), F.lit(1e-6))
    return df.groupBy(*key).agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value), F.count(F.lit(1)).alias("n"))


def rounded_mean(column: str) -> Column:
    """Integer mean, halves up."""
    n = F.count(column)
    return F.floor((F.sum(column) + F.floor(n / 2)) / n).cast("long")


def consensus(df: DataFrame, key: list[str], sample: str, rules: dict[str, tuple[int, float]]) -> DataFrame:
    """key, field, n, keep: a field stays if enough samples have it, in number and in share."""
    n_all = F.count_distinct(sample)
    g = df.groupBy(*key).agg(n_all.alias("_all"), *[F.count_if(F.col(c).isNotNull()).alias(c) for c in rules])
    pairs = [F.struct(F.lit(c).alias("field"), F.col(c).alias("n"), ((F.col(c) >= k) & (F.col(c) / F.col("_all") >= r)).alias("keep")) for c, (k, r) in rules.items()]
    return g.select(*key, F.explode(F.array(*pairs)).alias("x")).select(*key, "x.*")


def examples(df: DataFrame, reason: str, order: str, text: str, k: int = 3) -> DataFrame:
    """Rejections by reason: their number, and the first k texts."""
    d = df.withColumn("_r", F.row_number().over(Window.partitionBy(reason).orderBy(order)))
    return d.groupBy(reason).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= k, F.struct("_r", text)))), lambda x: x[text]), "|").alias("examples"))


def mode(df: DataFrame, key: list[str], left: Column, right: Column) -> DataFrame:
    """left_only, right_only or bimanual; groups without any hand are left out."""
    g = df.groupBy(*key).agg(F.bool_or(left).alias("_l"), F.bool_or(right).alias("_r"))
    return g.filter("_l or _r").select(*key, F.when(F.col("_l") & F.col("_r"), "bimanual").when(F.col("_l"), "left_only").otherwise("right_only").alias("mode"))
