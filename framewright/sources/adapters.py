"""Frame-like tables made from the star-schema and corpus tables.

frames: one row for each clip (user) and time slot with an event; the slots are sparse, so runs,
gaps and windows are not trivial. detections: hands seen in a frame. vectors: embeddings as
per-clip trajectories. captions, episodes: text and numeric sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = 1704067200000000
SLOT, HOUR = 21600000000, 3600000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slot(ts: str, micros: int) -> Column:
    """Number of the time slot of a timestamp."""
    return F.expr(f"cast((unix_micros(cast({ts} as timestamp)) - {EPOCH}) div {micros} as int)")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, frame_id, event_id, value, n: users over slots of six hours."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("clip_id"), slot("ts", SLOT).alias("frame_id")).agg(F.min("event_id").alias("event_id"), F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))


def frames_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over ten clips and slots of an hour: long runs."""
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("user_id") % 10).alias("clip_id"), slot("ts", HOUR).alias("frame_id")).agg(F.min("event_id").alias("event_id"), F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, frame_id, hand_idx, event_id, side, conf, x1, y1, x2, y2: some boxes are empty."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), slot("ts", SLOT).alias("frame_id"), "event_id", "value")
    number = F.row_number().over(Window.partitionBy("clip_id", "frame_id").orderBy("event_id")) - 1
    e = e.withColumn("hand_idx", number.cast("int")).withColumn("side", (F.col("event_id") % 2).cast("int")).withColumn("conf", F.col("value") / 500)
    e = e.withColumn("x1", (F.col("event_id") * 37 % 400).cast("double")).withColumn("y1", (F.col("event_id") * 53 % 300).cast("double"))
    return e.withColumn("x2", F.col("x1") + (F.col("event_id") % 11 - 2) * 10).withColumn("y2", F.col("y1") + (F.col("event_id") % 7 - 1) * 12).drop("value")


def hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, frame_id, hands: the detections nested in order."""
    one = F.struct("hand_idx", "side", "conf", "x1", "y1", "x2", "y2")
    return detections(spark, sf_dir).groupBy("clip_id", "frame_id").agg(F.array_sort(F.collect_list(one)).alias("hands"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip_id, frame_id, v (doubles): embeddings in trajectories of their label."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("clip_id"), F.col("vec_id").alias("frame_id"), F.col("embedding").cast("array<double>").alias("v"))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode, t, and numbers of the lines of an order, in a total order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").withColumn("t", (F.row_number().over(order) - 1).cast("int")).withColumnRenamed("l_orderkey", "episode")


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cap_id, text: phrases of a verb and a part's name, some joined by ' and '."""
    verbs = F.array(*[F.lit(v) for v in ("pick", "hold", "move", "open", "carry", "look", "place", "cut")])
    p = table(spark, sf_dir, "part")
    a = F.concat(F.element_at(verbs, (F.col("p_partkey") % 8 + 1).cast("int")), F.lit(" the "), F.col("p_name"))
    b = F.concat(a, F.lit(" and "), F.element_at(verbs, (F.col("p_size") % 8 + 1).cast("int")), F.lit(" it"))
    return p.select(F.col("p_partkey").alias("cap_id"), F.when(F.col("p_partkey") % 3 == 0, b).when(F.col("p_partkey") % 7 == 0, F.lit("n/a")).otherwise(a).alias("text"), "p_size", "p_brand")
