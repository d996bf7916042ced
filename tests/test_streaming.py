"""A replay through the stream gives what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from framewright.operators import sequences as S
from framewright.sources.adapters import frames, frames_long
from framewright.streaming import sessions as T

SF = "/root/testdata/sf0.001"


def replay(spark, tmp, df, cuts):
    """df in micro-batches of frames below each cut, then the end markers."""
    cuts = [-(10**9), *cuts, 10**9]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        df.filter((F.col("frame_id") >= a) & (F.col("frame_id") < b)).select("clip_id", "frame_id").coalesce(1).write.parquet(f"{tmp}/in/{i}")
    df.select("clip_id", F.lit(T.END).alias("frame_id")).distinct().coalesce(1).write.parquet(f"{tmp}/in/{len(cuts)}")
    return spark.readStream.schema("clip_id long, frame_id int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp}/in")


def collected(spark, tmp, out, name):
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp}/cp").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return sorted(map(tuple, spark.table(name).collect()))


def test_gap_sessions(spark, tmp_path):
    f = frames(spark, SF)
    got = collected(spark, tmp_path, T.gap_sessions(replay(spark, tmp_path, f, [40, 90]), 3, 5), "g")
    want = S.gap_sessions(f, ["clip_id"], min_span=5).select("clip_id", "start_frame", "end_frame", "n_frames").collect()
    assert got == sorted(map(tuple, want)) and got


@pytest.mark.parametrize("kind", ["count", "slide"])
def test_windows(spark, tmp_path, kind):
    f = frames_long(spark, "/root/testdata/sf0.01").filter("clip_id < 3")
    s = replay(spark, tmp_path, f, [150, 400])
    if kind == "count":
        got = collected(spark, tmp_path, T.count_windows(s), "c")
        want = S.count_windows(f, ["clip_id"]).select("clip_id", "w_start", "w_end").collect()
    else:
        got = collected(spark, tmp_path, T.sliding_windows(s, 210, 105), "s")
        want = S.sliding_windows(S.gap_sessions(f, ["clip_id"]), 210, 105).select("clip_id", "w_start", "w_end").collect()
    assert got == sorted(map(tuple, want)) and got


def test_watermark(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = T.tumbling_counts(s).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert spark.table("w").agg(F.sum("n")).first()[0] == e.count()
