"""Dataset metadata: tasks, episodes, info and modality documents, and footers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS, EPISODES = "task_index long, task string", "episode_index long, tasks array<string>, length long, clip_id string, seg_name string"
SLICE = "struct<original_key:string,start:int,`end`:int>"
#: Fixed values of the format.
VERSION = "v2.0"
DATA_PATH = "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet"
VIDEO_PATH = "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4"


def tasks(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(TASKS).json(f"{root}/meta/tasks.jsonl")


def episodes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(EPISODES).json(f"{root}/meta/episodes.jsonl")


def document(spark: SparkSession, root: str, name: str) -> dict:
    """info or modality as one small document; {} where there is none."""
    try:
        return json.loads(spark.read.text(f"{root}/meta/{name}.json", wholetext=True).first()["value"])
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return {}
        raise


def slices(spark: SparkSession, root: str) -> DataFrame:
    """part, name, original_key, start, end of the named slices of the vectors."""
    doc = document(spark, root, "modality")
    rows = [(part, name, x["original_key"], x["start"], x["end"]) for part in ("state", "action") for name, x in doc.get(part, {}).items()]
    return spark.createDataFrame(rows, "part string, name string, original_key string, start int, end int")


def modality(groups: list[tuple[str, int]], video: str) -> dict:
    """Slices of state and action for joint groups (name, size) in order, one camera, one annotation."""
    out: dict = {"state": {}, "action": {}, "video": {video: {"original_key": f"observation.images.{video}"}}, "annotation": {"human.coarse_action": {"original_key": "annotation.human.coarse_action"}}}
    at = 0
    for name, size in groups:
        for part, key in (("state", "observation.state"), ("action", "action")):
            out[part][name] = {"original_key": key, "start": at, "end": at + size}
        at += size
    return out


def info(totals: dict[str, int], fps: float, robot: str, features: dict, chunk: int = 1000) -> dict:
    """The dataset's document from its totals (total_frames, total_episodes, total_tasks)."""
    n = totals["total_episodes"]
    return {"codebase_version": VERSION, "robot_type": robot, **{k: totals[k] for k in ("total_episodes", "total_frames", "total_tasks")}, "total_videos": n, "total_chunks": -(-n // chunk), "chunks_size": chunk, "fps": float(fps), "splits": {"train": f"0:{n}"}, "data_path": DATA_PATH, "video_path": VIDEO_PATH, "features": features}


def write_document(spark: SparkSession, doc: dict, root: str, name: str) -> None:
    """One JSON file, written beside its place and renamed into it, so that no reader meets half of it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/meta/{name}.json")
    fs = path.getFileSystem(conf)
    part = jvm.org.apache.hadoop.fs.Path(f"{root}/meta/.{name}.json.part")
    stream = fs.create(part, True)
    stream.write(bytearray((json.dumps(doc, indent=2) + "\n").encode()))
    stream.close()
    fs.delete(path, False)
    if not fs.rename(part, path):
        raise OSError(f"cannot rename {part} to {path}")


def footer(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number of rows and column names; the scan reads no column, so only footers are touched."""
    df = spark.read.parquet(path)
    return df.select().count(), df.columns


def readable(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Rows of all Parquet files under root that can be read, and the paths of the files that gave none."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(root).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))
    df = spark.read.option("ignoreCorruptFiles", "true").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(root)
    seen = df.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file")).distinct()
    return df, names.join(seen, "file", "left_anti")
