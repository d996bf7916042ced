"""Queries of the episode export: indices, offsets, paths, totals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.operators import export as X
from framewright.plans.registry import EP, query
from framewright.sources.adapters import episodes, table

_EPI = "epi AS (SELECT l_orderkey AS episode, count(*) AS length, min(l_returnflag) AS task, CAST(min(l_suppkey) % 3 AS BIGINT) AS res FROM lineitem GROUP BY 1)"
_IDX = f"{_EPI}, ix AS (SELECT *, row_number() OVER (ORDER BY episode) - 1 AS episode_index, sum(length) OVER (ORDER BY episode) - length AS frame_offset FROM epi)"


def lengths(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("episode")).agg(F.count(F.lit(1)).alias("length"), F.min("l_returnflag").alias("task"), (F.min("l_suppkey") % 3).alias("res"))


@query(f"WITH {_EPI} SELECT DISTINCT task, CAST(dense_rank() OVER (ORDER BY task) - 1 AS BIGINT) AS task_index FROM epi")
def task_index(spark, d):
    return X.task_table(lengths(spark, d), "task")


@query(f"WITH {_IDX} SELECT episode, CAST(episode_index AS BIGINT) AS episode_index, CAST(frame_offset AS BIGINT) AS frame_offset FROM ix")
def global_frame_offset(spark, d):
    return X.episode_table(lengths(spark, d), "episode", "length").select("episode", "episode_index", "frame_offset")


@query(f"WITH {_EPI} SELECT res, count(*) AS n, CAST(sum(length) AS BIGINT) AS frames FROM epi GROUP BY 1")
def resolution_groups(spark, d):
    return lengths(spark, d).groupBy("res").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("frames"))


@query(f"""WITH {EP}, {_IDX} SELECT ix.episode_index, CAST(ep.t AS BIGINT) AS frame_index, round(ep.t / 30.0::DOUBLE, 6) AS timestamp, CAST(ix.frame_offset + ep.t AS BIGINT) AS index, ep.t = ix.length - 1 AS done FROM ep JOIN ix USING (episode)""")
def episode_columns(spark, d):
    return X.frame_columns(episodes(spark, d).select("episode", "t"), X.episode_table(lengths(spark, d), "episode", "length"), "episode", "t", fps=30).withColumn("timestamp", F.round("timestamp", 6))


@query(f"WITH {_IDX} SELECT CAST(episode_index AS BIGINT) AS episode_index, 'data/chunk-' || lpad(CAST(episode_index // 1000 AS VARCHAR), 3, '0') || '/episode_' || lpad(CAST(episode_index AS VARCHAR), 6, '0') || '.parquet' AS path FROM ix")
def episode_paths(spark, d):
    return X.paths(X.episode_table(lengths(spark, d), "episode", "length"), fixed=True).select("episode_index", "path")


@query(f"""WITH {_EPI}, t AS (SELECT DISTINCT task, dense_rank() OVER (ORDER BY task) - 1 AS i FROM epi) SELECT '{{"task_index":' || i || ',"task":"' || task || '"}}' AS line FROM t""")
def tasks_jsonl(spark, d):
    return X.jsonl(X.task_table(lengths(spark, d), "task"), ["task_index", "task"])


@query(f"WITH {_EPI} SELECT CAST(sum(length) AS BIGINT) AS total_frames, count(*) AS total_episodes, count(DISTINCT task) AS total_tasks, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS total_chunks FROM epi")
def dataset_totals(spark, d):
    return X.totals(lengths(spark, d), "length", "task")


@query(f"WITH {_EPI} SELECT sha256(string_agg(episode || chr(9) || length || chr(9) || task, chr(10) ORDER BY episode)) AS hash FROM epi")
def episodes_hash(spark, d):
    return X.fingerprint(lengths(spark, d), "episode", ["episode", "length", "task"])


@query(f"WITH {_EPI} SELECT episode, CAST(unnest(range(length)) AS INTEGER) AS t FROM epi")
def expand_episode_frames(spark, d):
    return X.expanded(lengths(spark, d), "length").select("episode", "t")


@query("SELECT p_brand AS name, count(*) AS size, CAST(sum(count(*)) OVER (ORDER BY p_brand) - count(*) AS BIGINT) AS start FROM part GROUP BY 1")
def layout_running_offsets(spark, d):
    g = table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count(F.lit(1)).alias("size"))
    return X.layout(g, "name", "size")
