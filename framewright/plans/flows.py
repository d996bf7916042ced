"""Whole flows: frames to captioned segments, and segments to an indexed episode dataset."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import captions as C
from framewright.operators import export as X
from framewright.operators import filters as P
from framewright.operators import matching as M
from framewright.operators import robust as R
from framewright.operators import sequences as S
from framewright.operators.ports import Port, caption_stub
from framewright.plans.registry import query
from framewright.plans.texts import _NARRATION, merged, narration
from framewright.sources.adapters import frames

#: Agreement that a field needs: samples, share.
CONSENSUS = {"left": (2, 0.4), "right": (2, 0.4), "bimanual": (1, 0.25)}


def _valid(s: str) -> str:
    out, _, reason = C.validated(json.loads(s))
    return json.dumps({**out, "reason": reason})


def segments(df: DataFrame, port: Port, gap_fill: int = 3, min_span: int = 50, length: int = 210, stride: int = 105, samples: int = 4, people: str | None = None) -> DataFrame:
    """clip_id, seg_name, w_start, w_end, left, right, bimanual, language.

    Sessions, a gate on crowded ones, windows, trimming to the first and last frame of contact,
    sampled captions, validation, consensus by field, selection, a last check. Windows without a
    surviving field are dropped.
    """
    runs = S.gap_sessions(df, ["clip_id"], gap_fill=gap_fill, min_span=min_span)
    if people:
        tagged = S.run_ids(df, ["clip_id"], gap_fill=gap_fill)
        crowded = tagged.filter(F.pmod("frame_id", F.lit(8)) == 0).groupBy("clip_id", "run_id").agg(F.count_if(F.col(people) >= 3).alias("_c")).filter("_c >= 2")
        runs = runs.join(crowded, ["clip_id", "run_id"], "left_anti")
    windows = S.sliding_windows(runs, length, stride).select("clip_id", "w_start", "w_end")
    inside = M.in_windows(df, windows, ["clip_id"])
    trimmed = inside.groupBy("clip_id", F.col("w_start").alias("ws"), F.col("w_end").alias("we")).agg(F.min("frame_id").alias("w_start"), F.max("frame_id").alias("w_end")).select("clip_id", "w_start", "w_end").distinct()
    answers = port.rows(trimmed.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))))
    n = answers.withColumn("x", narration(F.col("answer"))).filter("x.reason is null")
    ok = n.withColumn("v", F.from_json(C.column(_valid)(F.to_json("x")), _NARRATION)).filter("v.reason is null")
    key = ["clip_id", "w_start", "w_end"]
    fields = ok.select(*key, "sample", *[F.nullif(F.col(f"v.{f}"), F.lit("n/a")).alias(f) for f in C.FIELDS])
    flat = fields.select(*key, "sample", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in C.FIELDS])).alias("x")).select(*key, "sample", "x.*").filter("text is not null")
    kept = R.consensus(fields, key, "sample", CONSENSUS).filter("keep").select(*key, "field")
    flat = flat.join(kept, [*key, "field"]).withColumn("n_phrases", F.size(F.split("text", r", | and "))).withColumn("freq", F.count(F.lit(1)).over(Window.partitionBy(*key, "field", "text")))
    best = S.first_of(flat, [*key, "field"], F.desc("n_phrases"), F.desc("freq"), F.col("sample"))
    wide = best.groupBy(*key).agg(*[F.coalesce(F.max(F.when(F.col("field") == f, F.col("text"))), F.lit("n/a")).alias(f) for f in C.FIELDS])
    check = C.column(lambda s: json.dumps(C.postchecked(json.loads(s))[0]))
    wide = wide.select(*key, F.from_json(check(F.to_json(F.struct(*C.FIELDS))), "left string, right string, bimanual string").alias("p")).select(*key, "p.*")
    wide = wide.withColumn("language", merged(F.col("left"), F.col("right"), F.col("bimanual"))).filter("language <> 'n/a'")
    return wide.withColumn("seg_name", X.segment_name("w_start", "w_end"))


def exported(df: DataFrame, episode: str, t: str, language: str, valid: str, state: str, diagnostics: dict[str, float], fps: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frame rows, episodes and tasks of the dataset: gate, threshold filter over all episodes, dense indices, next-frame actions."""
    gate = P.render_gate(df, [episode], t, language, valid).withColumnRenamed("language", "task")
    diag = R.ordered_means(df, [episode], t, list(diagnostics), "length")
    keep = R.within_thresholds(gate.join(diag, episode), diagnostics)
    tasks = X.task_table(keep, "task")
    episodes = X.episode_table(keep.join(tasks, "task"), episode, "length")
    rows = S.next_value(df.join(keep.select(episode), episode, "left_semi"), [episode], t, state, "action").select(episode, t, F.col(state).alias("state"), "action")
    cols = X.frame_columns(rows.select(episode, t), episodes, episode, t, fps)
    out = rows.join(episodes.select(episode, "episode_index", "task_index"), episode).withColumnRenamed(t, "frame_index")
    return out.join(cols, ["episode_index", "frame_index"]), episodes, tasks


@query()
def captioned_segments(spark, d):
    return segments(frames(spark, d), caption_stub(), min_span=16)


@query("""WITH ep AS (SELECT l_orderkey AS episode, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS t, * FROM lineitem),
g AS (SELECT episode, max(CASE WHEN t = 0 THEN l_returnflag END) AS task, bool_and(l_discount < 0.1) AS ok, avg(l_tax) AS tax, count(*) AS length FROM ep GROUP BY 1), h AS (SELECT * FROM g WHERE ok),
k AS (SELECT * FROM h WHERE tax <= (SELECT quantile_cont(tax, 0.99) FROM h)), n AS (SELECT *, row_number() OVER (ORDER BY episode) - 1 AS episode_index, sum(length) OVER (ORDER BY episode) - length AS off, dense_rank() OVER (ORDER BY task) - 1 AS task_index FROM k)
SELECT n.episode_index, CAST(n.task_index AS BIGINT) AS task_index, CAST(n.off + t AS BIGINT) AS index, l_quantity AS state, coalesce(lead(l_quantity) OVER (PARTITION BY n.episode ORDER BY t), l_quantity) AS action, t = n.length - 1 AS done FROM ep JOIN n USING (episode)""")
def exported_dataset(spark, d):
    from framewright.sources.adapters import episodes

    e = episodes(spark, d).withColumn("ok", F.col("l_discount") < 0.1).select("episode", "t", "l_returnflag", "ok", "l_quantity", "l_tax")
    rows, _, _ = exported(e, "episode", "t", "l_returnflag", "ok", "l_quantity", {"l_tax": 0.99})
    return rows.select("episode_index", "task_index", "index", "state", "action", "done")


@query()
def detected_frames(spark, d):
    """A detector port over frames, then its valid boxes by side."""
    from framewright.operators.ports import detect_stub

    q = detect_stub().rows(frames(spark, d).select("clip_id", "frame_id"))
    return q.filter("conf > 0.5").groupBy("clip_id", "side").agg(F.count(F.lit(1)).alias("n"))
