"""Windows and sequences over frames: sessions, window cuts, interpolation, smoothing.

All functions take a key (list of columns) and an integer frame column and order by them alone,
so (key, frame) must be unique, unless a tie-break is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(key: list[str], *order: str) -> Window:
    return Window.partitionBy(*key).orderBy(*order)


def run_ids(df: DataFrame, key: list[str], frame: str = "frame_id", gap_fill: int = 3, out: str = "run_id") -> DataFrame:
    """Number of the run of each frame: a new one begins when more than gap_fill frames are missing."""
    prev = F.lag(frame).over(by(key, frame))
    new = F.when(prev.isNull() | (F.col(frame) > prev + 1 + gap_fill), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(by(key, frame).rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_sessions(df: DataFrame, key: list[str], frame: str = "frame_id", gap_fill: int = 3, min_span: int = 1) -> DataFrame:
    """key, run_id, start_frame, end_frame, n_frames, span of the runs of at least min_span frames from end to end."""
    runs = run_ids(df, key, frame, gap_fill).groupBy(*key, "run_id").agg(F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"), F.count(F.lit(1)).alias("n_frames"))
    return runs.withColumn("span", F.col("end_frame") - F.col("start_frame") + 1).filter(F.col("span") >= min_span)


def sliding_windows(runs: DataFrame, length: int, stride: int, start: str = "start_frame", end: str = "end_frame") -> DataFrame:
    """Overlapping windows over each run: full ones by stride, and one aligned to the end; a short run is one window."""
    last = F.greatest(F.col(start), F.col(end) - (length - 1))
    starts = F.array_distinct(F.concat(F.sequence(F.col(start), last, F.lit(stride)), F.array(last)))
    return runs.withColumn("w_start", F.explode(starts)).withColumn("w_end", F.least(F.col("w_start") + length - 1, F.col(end)))


def count_windows(df: DataFrame, key: list[str], frame: str = "frame_id", size: int = 16, stride: int = 12, gap_fill: int = 3) -> DataFrame:
    """Windows of `size` valid frames in a run, every `stride`, and the last `size`; too wide ones are left out.

    A window may be at most size + gap_fill frames wide; the last one is added unless it starts
    where the last window that was kept does.
    """
    runs = run_ids(df, key, frame, gap_fill)
    lists = runs.groupBy(*key, "run_id").agg(F.sort_array(F.collect_list(frame)).alias("ids")).filter(F.size("ids") >= size)
    n = F.size("ids")
    cut = lambda s: F.struct(s.alias("at"), F.element_at("ids", s + 1).alias("w_start"), F.element_at("ids", s + size).alias("w_end"))
    fits = lambda w: w["w_end"] - w["w_start"] <= size - 1 + gap_fill
    lists = lists.withColumn("ws", F.filter(F.transform(F.sequence(F.lit(0), n - size, F.lit(stride)), cut), fits)).withColumn("tail", cut(n - size))
    tail = F.when(fits(F.col("tail")) & ~F.exists("ws", lambda w: w["at"] == F.col("tail.at")), F.array("tail")).otherwise(F.slice("ws", 1, 0))
    return lists.withColumn("w", F.explode(F.concat("ws", tail))).select(*key, "run_id", "w.w_start", "w.w_end")


def every_nth_block(df: DataFrame, key: list[str], frame: str, size: int, least: int) -> DataFrame:
    """Blocks of `size` rows in order; a shorter last block counts from `least` rows. Half-open [w_start, w_end)."""
    n = F.floor((F.row_number().over(by(key, frame)) - 1) / size).cast("int")
    b = df.withColumn("block", n).groupBy(*key, "block").agg(F.min(frame).alias("w_start"), (F.max(frame) + 1).alias("w_end"), F.count(F.lit(1)).alias("n_moving"))
    return b.filter(F.col("n_moving") >= least)


def uniform_pick(df: DataFrame, key: list[str], frame: str, count: int) -> DataFrame:
    """At most `count` rows at truncated even steps from first to last."""
    number, total = F.row_number().over(by(key, frame)) - 1, F.count(F.lit(1)).over(Window.partitionBy(*key))
    df = df.withColumn("_i", number).withColumn("_n", total)
    steps = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (count - 1)).cast("long"))
    return df.filter((F.col("_n") <= count) | F.array_contains(steps, F.col("_i").cast("long"))).drop("_i", "_n")


def thinned(df: DataFrame, key: list[str], frame: str, gap: int) -> DataFrame:
    """Greedy choice in order: a frame stays if it is at least `gap` after the last that stayed."""
    lists = df.groupBy(*key).agg(F.sort_array(F.collect_set(frame)).alias("ids"))
    kind = df.schema[frame].dataType.simpleString()
    keep = F.expr(f"aggregate(ids, cast(array() as array<{kind}>), (a, x) -> if(size(a) = 0 or x - try_element_at(a, -1) >= {gap}, array_append(a, x), a))")
    return lists.select(*key, F.explode(keep).alias(frame))


def densified(df: DataFrame, key: list[str], frame: str, carry: list[str]) -> DataFrame:
    """All frames from first to last; rows that were missing have `gap` true and the key's constants in `carry`."""
    ends = df.groupBy(*key).agg(F.min(frame).alias("_a"), F.max(frame).alias("_b"), *[F.first(c).alias(c) for c in carry])
    grid = ends.withColumn(frame, F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    own = df.drop(*carry).withColumn("_here", F.lit(True))
    return grid.join(own, [*key, frame], "left").withColumn("gap", F.col("_here").isNull()).drop("_here")


def neighbours(df: DataFrame, key: list[str], frame: str, value: str) -> DataFrame:
    """prev_frame, prev_value, next_frame, next_value: the nearest rows with a value, the row itself included."""
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(frame).alias("f"), F.col(value).alias("v")))
    back = by(key, frame).rowsBetween(Window.unboundedPreceding, 0)
    ahead = by(key, frame).rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_p", F.last(seen, True).over(back)).withColumn("_n", F.first(seen, True).over(ahead))
    return df.select(*df.columns[:-2], F.col("_p.f").alias("prev_frame"), F.col("_p.v").alias("prev_value"), F.col("_n.f").alias("next_frame"), F.col("_n.v").alias("next_value"))


def filled(df: DataFrame, key: list[str], frame: str, value: str, out: str, longest: int | None = None) -> DataFrame:
    """Linear interpolation between neighbours, nearest at the ends, 0 without any; with `longest`, only gaps of at most so many frames."""
    df = neighbours(df, key, frame, value)
    step = (F.col(frame) - F.col("prev_frame")) / F.nullif(F.col("next_frame") - F.col("prev_frame"), F.lit(0))
    inner = F.col("prev_value") + (F.col("next_value") - F.col("prev_value")) * step
    x = F.coalesce(F.col(value), inner, F.col("prev_value"), F.col("next_value"), F.lit(0.0))
    if longest is not None:
        x = F.coalesce(F.col(value), F.when(F.col("next_frame") - F.col("prev_frame") - 1 <= longest, inner))
    return df.withColumn(out, x)


def gaussian(size: int, sigma: float) -> list[float]:
    """A normalised kernel of odd size."""
    import math

    w = [math.exp(-0.5 * ((i - size // 2) / sigma) ** 2) for i in range(size)]
    return [x / sum(w) for x in w]


def smoothed(df: DataFrame, key: list[str], frame: str, value: str, kernel: list[float], out: str, pad: bool = False, weight: str | None = None, floor: float = 0.0) -> DataFrame:
    """Weighted mean of a row's neighbours; kernel weights beyond the ends are left out (pad: the end rows repeat).

    With `weight` (validity) both sums use it, and where the weights sum to less than `floor` the raw value stays.
    """
    w, half = by(key, frame), len(kernel) // 2
    top, low = F.lit(0.0), F.lit(0.0)
    first, last = F.first(F.struct(F.col(value).alias("v"), F.col(weight or value).alias("w"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.last(F.struct(F.col(value).alias("v"), F.col(weight or value).alias("w"))).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_first", first).withColumn("_last", last)
    for i, k in enumerate(kernel):
        d = i - half
        at = (lambda c: F.lead(c, d).over(w)) if d > 0 else (lambda c: F.lag(c, -d).over(w)) if d < 0 else F.col
        v, s = at(value), at(weight) if weight else F.lit(1.0)
        if pad and d:
            end = F.col("_last" if d > 0 else "_first")
            inside = at(value).isNotNull()
            v = F.when(inside, v).otherwise(end["v"])
            s = F.when(inside, s).otherwise(end["w"]) if weight else s
        top = top + F.coalesce(v * s * k, F.lit(0.0))
        low = low + F.when(v.isNotNull(), s * k).otherwise(0.0)
    mean = F.try_divide(top, low)
    return df.withColumn(out, F.when(low < floor, F.col(value)).otherwise(mean) if floor else mean).drop("_first", "_last")


def second_difference(df: DataFrame, key: list[str], frame: str, value: str, out: str) -> DataFrame:
    """x[t+1] - 2 x[t] + x[t-1]; the ends repeat their neighbour, and up to two rows give 0."""
    w, n = by(key, frame), F.count(F.lit(1)).over(Window.partitionBy(*key))
    d = F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w)
    df = df.withColumn("_d", d).withColumn("_n", n)
    x = F.coalesce("_d", F.lead("_d").over(w), F.lag("_d").over(w))
    return df.withColumn(out, F.when(F.col("_n") <= 2, 0.0).otherwise(x)).drop("_d", "_n")


def next_value(df: DataFrame, key: list[str], frame: str, value: str, out: str) -> DataFrame:
    """The next row's value; the last row repeats its own."""
    return df.withColumn(out, F.coalesce(F.lead(value).over(by(key, frame)), F.col(value)))


def top_share(df: DataFrame, key: list[str], score: str, tie: str, share: float, least: int) -> DataFrame:
    """The rows with the greatest scores: a share of the group, but at least `least`; null and NaN come last."""
    s = F.coalesce(F.nanvl(F.col(score), F.lit(None).cast("double")), F.lit(float("-inf")))
    df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(s.desc(), tie))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    return df.filter(F.col("_r") <= F.greatest(F.floor(F.col("_n") * share), F.least(F.lit(least), F.col("_n")))).drop("_r", "_n")


def speed_weights(df: DataFrame, key: list[str], frame: str, value: str | list[str], limit: float, fps: float, out: str, valid: str | None = None, least: float = 0.01) -> DataFrame:
    """exp(-score^4) of the greater of speed and acceleration over the limit, at least `least`; 0 where `valid` is not true.

    value: one coordinate or several. The first frame has no speed, the first and the last no acceleration.
    """
    w, axes = by(key, frame), [value] if isinstance(value, str) else value
    norm = lambda parts: F.sqrt(sum((p * p for p in parts), F.lit(0.0)))
    speed = norm([F.col(c) - F.lag(c).over(w) for c in axes])
    turn = norm([F.lead(c).over(w) - 2 * F.col(c) + F.lag(c).over(w) for c in axes])
    score = F.greatest(F.coalesce(speed, F.lit(0.0)), F.coalesce(turn, F.lit(0.0))) * fps / limit
    weight = F.greatest(F.exp(-F.pow(score, 4)), F.lit(least))
    return df.withColumn(out, F.when(F.col(valid), weight).otherwise(0.0) if valid else weight)


def waypoints(df: DataFrame, key: list[str], frame: str, every: int) -> DataFrame:
    """In each group the first frame, then the next at or after `every` more than the threshold, which moves on only after a hit."""
    lists = df.groupBy(*key).agg(F.sort_array(F.collect_set(frame)).alias("ids"))
    got = F.expr(f"aggregate(ids, named_struct('at', cast(array_min(ids) as bigint), 'out', cast(array() as array<bigint>)), (a, x) -> if(x >= a.at, named_struct('at', a.at + {every}, 'out', array_append(a.out, cast(x as bigint))), a), a -> a.out)")
    return lists.select(*key, F.explode(got).alias(frame))


def first_of(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")
