"""Scans and their bookkeeping: shards, markers, partitions of work, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shard_table(spark: SparkSession, root: str, columns: list[str] | None = None) -> DataFrame:
    """All shard files `<clip>_<number>.parquet` under root whose clip has a `<clip>.done` marker.

    Adds clip_id and shard from the file name; only `columns` and frame_id are read.
    """
    path = F.input_file_name()
    df = spark.read.option("pathGlobFilter", "*.parquet").parquet(root)
    df = df.select(*(sorted({"frame_id", *columns}) if columns else df.columns))
    df = df.withColumn("shard", F.regexp_extract(path, r"_(\d+)\.parquet$", 1).cast("int")).withColumn("clip_id", F.regexp_extract(path, r"([^/]+)_\d+\.parquet$", 1))
    return df.join(marked(spark, root), "clip_id", "left_semi")


def marked(spark: SparkSession, root: str, suffix: str = ".done") -> DataFrame:
    """clip_id of the markers under root. Markers are empty files, which Spark's readers pass over, so the driver lists them: one name a clip."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/*{suffix}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return spark.createDataFrame([(f.getPath().getName()[: -len(suffix)],) for f in found], "clip_id string")


def clips(spark: SparkSession, root: str, suffix: str = ".mp4") -> DataFrame:
    """clip_id and path of the files with this suffix (case counts), without their contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(root).select("path")
    return files.select(F.regexp_extract("path", rf"([^/]+){suffix.replace('.', chr(92) + '.')}$", 1).alias("clip_id"), "path").orderBy("path")


def intrinsics(spark: SparkSession, root: str) -> DataFrame:
    """One row for each clip with usable intrinsics; `{}` marks a dropped clip."""
    kind = "fx double, fy double, cx double, cy double, xi double, H int, W int, model string"
    df = spark.read.schema(kind).option("multiLine", "true").json(root).withColumn("clip_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return df.filter("fx is not null")


def parsed(df: DataFrame, column: str, schema: str) -> DataFrame:
    """df with struct `p` of the JSON in column."""
    return df.withColumn("p", F.from_json(column, schema))


def _on(a: DataFrame, b: DataFrame, keys: dict[str, str]) -> list[Column]:
    return [a[x] == b[y] for x, y in keys.items()]


def completed(df: DataFrame, markers: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows whose key has a marker."""
    return df.join(markers, _on(df, markers, keys), "left_semi")


def todo(df: DataFrame, markers: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows whose key has no marker."""
    return df.join(markers, _on(df, markers, keys), "left_anti")


def last_shard(df: DataFrame, key: list[str], shard: str) -> DataFrame:
    """Of rows with the same key the one from the last shard."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(shard, *[c for c in rest if c != shard])).alias("_x")).select(*key, "_x.*")


def shard_numbers(df: DataFrame, key: list[str], order: str, rows: int) -> DataFrame:
    """Shard number of each row when shards hold `rows` rows in order."""
    return df.withColumn("shard", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1) / rows).cast("int"))


def columns_with_data(df: DataFrame) -> DataFrame:
    """column_name and number of non-null values of the columns that have any."""
    one = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*df.columns))).alias("column_name", "n")).filter("n > 0")


def pair_counts(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Both counts for each key, and whether they are the same."""
    return a.join(b, key, "full_outer").withColumn("valid", F.col(left).eqNullSafe(F.col(right)))


def discovered(annotations: DataFrame, videos: DataFrame, key: str) -> DataFrame:
    """key and status: kept, annotation_only or video_only."""
    a, b = annotations.select(key).withColumn("_a", F.lit(True)), videos.select(key).withColumn("_b", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_b").isNull(), "annotation_only").when(F.col("_a").isNull(), "video_only").otherwise("kept").alias("status"))


def check_part(a: int, b: int) -> None:
    if not 1 <= a <= b:
        raise ValueError(f"part {a}/{b}: needs 1 <= a <= b")


def hash_part(df: DataFrame, key: str, a: int, b: int) -> DataFrame:
    """Part a of b by CRC-32 of the key's UTF-8 bytes."""
    check_part(a, b)
    return df.filter(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % b == a - 1)


def index_part(df: DataFrame, order: str, a: int, b: int, cuts: int = 64) -> DataFrame:
    """Every b-th row in order of a numeric column, from the a-th.

    Rows are numbered within value ranges and shifted by the sizes of the ranges before theirs,
    so no task orders the whole table.
    """
    check_part(a, b)
    bounds = sorted(set(df.approxQuantile(order, [i / cuts for i in range(1, cuts)], 0.002)))
    span = F.lit(0)
    for x in bounds:
        span = span + (F.col(order) > x).cast("int")
    part = df.withColumn("_p", span)
    before = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = part.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.coalesce(before, F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    # at most `cuts` rows
    return part.withColumn("_i", own).join(F.broadcast(sizes), "_p").filter((F.col("_i") + F.col("_b")) % b == a - 1).drop("_p", "_i", "_b")
