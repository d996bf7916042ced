"""Joins: windows and frames, tracks, overlaps, nested updates, alignment, ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.sequences import first_of


def in_windows(df: DataFrame, windows: DataFrame, key: list[str], frame: str = "frame_id", bucket: int = 64) -> DataFrame:
    """Every frame with each window that holds it.

    Windows are listed once for each bucket of `bucket` frames that they touch, so the range
    condition is checked within an equi-join and not over all pairs of a key.
    """
    w = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col("w_start") / bucket), F.floor(F.col("w_end") / bucket))))
    return df.withColumn("_b", F.floor(F.col(frame) / bucket)).join(w, [*key, "_b"]).filter(F.col(frame).between(F.col("w_start"), F.col("w_end"))).drop("_b")


def window_overlaps(windows: DataFrame, members: DataFrame, key: list[str], number: str = "w_no", frame: str = "frame_id", least: int = 2) -> DataFrame:
    """Window numbers that share at least `least` frames with their predecessor, and how many."""
    a = members.select(*key, number, frame)
    b = members.select(*key, (F.col(number) + 1).alias(number), frame)
    return a.join(b, [*key, number, frame]).groupBy(*key, number).agg(F.count(F.lit(1)).alias("n_shared")).filter(F.col("n_shared") >= least)


def conflicts(members: DataFrame, clip: list[str], track: str, side: str, frame: str) -> DataFrame:
    """Pairs of tracks of one clip and side that share a frame. Pairs meet frame by frame, where few tracks do."""
    a = members.select(*clip, side, frame, F.col(track).alias("a")).distinct()
    b = a.withColumnRenamed("a", "b")
    return a.join(b, [*clip, side, frame]).filter("a < b").groupBy(*clip, side, "a", "b").agg(F.count(F.lit(1)).alias("n_frames"))


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over the smaller area of two boxes (x1, y1, x2, y2)."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return F.try_divide(w * h, F.least(size(a), size(b)))


def best_overlap(seeds: DataFrame, boxes: DataFrame, key: list[str], least: float = 0.5) -> DataFrame:
    """For each seed box its first best overlapping box of the same key, over `least`."""
    c = ("x1", "y1", "x2", "y2")
    s = seeds.select(*key, "seed", *[F.col(x).alias(f"s_{x}") for x in c])
    j = s.join(boxes, key).withColumn("overlap", overlap(tuple(F.col(f"s_{x}") for x in c), tuple(map(F.col, c)))).filter(F.col("overlap") > least)
    return first_of(j, [*key, "seed"], F.desc("overlap"), F.col("hand_idx")).select(*key, "seed", "hand_idx", "overlap")


def updated(hands: DataFrame, updates: DataFrame, key: list[str], column: str = "hands") -> DataFrame:
    """Nested hands with new side and confidence by (key, hand_idx); hands without an update go, as do rows without hands."""
    flat = hands.select(*key, F.posexplode(column).alias("_i", "h"))
    u = updates.select(*key, F.col("hand_idx").alias("_i"), F.col("side").alias("_s"), F.col("side_conf").alias("_c"))
    j = flat.join(u, [*key, "_i"]).withColumn("h", F.col("h").withField("side", F.col("_s")).withField("side_conf", F.col("_c")))
    return j.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "h"))), lambda x: x["h"]).alias(column))


def flipped(losers: DataFrame, winners: DataFrame, key: list[str]) -> DataFrame:
    """Losing tracks (track, frame_id, side, side_conf): the side that their co-occurring winners leave free, if those agree, else the other one."""
    seen = losers.join(winners.select(*key, "frame_id", F.col("side").alias("w_side")), [*key, "frame_id"], "left")
    g = seen.groupBy(*key, "track").agg(F.max("side").alias("old"), F.max("side_conf").alias("conf"), F.array_sort(F.collect_set("w_side")).alias("taken"))
    new = F.when(F.size("taken") == 1, 1 - F.element_at("taken", 1)).otherwise(1 - F.col("old"))
    return g.withColumn("side", new).withColumn("side_conf", F.when(F.col("side") != F.col("old"), 1 - F.col("conf")).otherwise(F.col("conf"))).select(*key, "track", "side", "side_conf")


def zipped(a: DataFrame, b: DataFrame, key: list[str], index: str) -> DataFrame:
    """Rows of equal index, to the shorter length."""
    return a.join(b, [*key, index])


def ancestors(links: DataFrame, child: str, parent: str, depth: int = 64) -> DataFrame:
    """node, ancestor, steps: the closure of a small parent table, level by level until no link is left."""
    base = links.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).filter("ancestor is not null")
    level, out, k = base, base.withColumn("steps", F.lit(1)), 1
    up = base.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"))
    while k < depth and (level := level.join(up, "ancestor").select("node", F.col("next").alias("ancestor"))).limit(1).count():
        k += 1
        out = out.union(level.withColumn("steps", F.lit(k)))
    return out


def remapped(state: Column, source: list[str], target: list[str]) -> Column:
    """Values in the target's order of names; names that the source lacks give 0, names that the target lacks are an error."""
    if unknown := set(source) - set(target):
        raise ValueError(f"unknown joints: {sorted(unknown)}")
    at = {n: i for i, n in enumerate(source)}
    return F.array(*[F.coalesce(F.get(state, at[n]), F.lit(0.0)) if n in at else F.lit(0.0) for n in target])


def mimicked(state: Column, names: list[str], mimic: dict[str, tuple[str, float, float]]) -> Column:
    """Joints that follow another one: factor * parent + offset; the others keep their value."""
    at = {n: i for i, n in enumerate(names)}
    value = lambda n: F.get(state, at[n])
    return F.array(*[value(mimic[n][0]) * mimic[n][1] + mimic[n][2] if n in mimic else value(n) for n in names])
