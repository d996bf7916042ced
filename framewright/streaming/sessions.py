"""Structured Streaming counterparts of the frame windows.

Each keeps a small state for a clip (run bounds, the last frames) in applyInPandasWithState; rows
of a micro-batch are taken in frame order, and a clip's frames must come in order from batch to
batch. The end of a clip is a marker row (frame -1), as a stream has no end of its own; a
replay of a finished table so gives what the batch operators give.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

END = -1


def _ordered(batches: Iterator[pd.DataFrame]) -> tuple[list[int], bool]:
    ids: list[int] = []
    for b in batches:
        ids += b["frame_id"].astype(int).tolist()
    return sorted(i for i in ids if i != END), END in ids


def gap_sessions(stream: DataFrame, gap_fill: int = 3, min_span: int = 1) -> DataFrame:
    """clip_id, start_frame, end_frame, n_frames of the runs, each when the next frame or the end closes it."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, n = state.get if state.exists else (None, None, 0)
        frames, end = _ordered(batches)
        out = []
        for f in frames:
            if start is not None and f > last + 1 + gap_fill:
                out.append((start, last, n))
                start, n = None, 0
            start, last, n = f if start is None else start, f, n + 1
        if end and start is not None:
            out.append((start, last, n))
            start, last, n = None, None, 0
        if start is None:
            if state.exists:
                state.remove()
        else:
            state.update((start, last, n))
        rows = [(key[0], a, b, c) for a, b, c in out if b - a + 1 >= min_span]
        yield pd.DataFrame(rows, columns=["clip_id", "start_frame", "end_frame", "n_frames"])

    return stream.groupBy("clip_id").applyInPandasWithState(step, "clip_id long, start_frame int, end_frame int, n_frames long", "start int, last int, n long", "append", GroupStateTimeout.NoTimeout)


def count_windows(stream: DataFrame, size: int = 16, stride: int = 12, gap_fill: int = 3) -> DataFrame:
    """clip_id, w_start, w_end of the windows of `size` valid frames, as the frames come."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, seen, kept = (list(state.get[0]), *state.get[1:]) if state.exists else ([], 0, -1)
        frames, end = _ordered(batches)
        out = []

        def window(at: int) -> None:
            nonlocal kept
            if tail[-1] - tail[-size] <= size - 1 + gap_fill:
                out.append((key[0], tail[-size], tail[-1]))
                kept = at

        def close() -> None:
            nonlocal tail, seen, kept
            if seen >= size and kept != seen - size:
                window(seen - size)
            tail, seen, kept = [], 0, -1

        for f in frames:
            if tail and f > tail[-1] + 1 + gap_fill:
                close()
            tail, seen = [*tail[1 - size :], f] if size > 1 else [f], seen + 1
            if seen >= size and (seen - size) % stride == 0:
                window(seen - size)
        if end:
            close()
        if seen:
            state.update((tail, seen, kept))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["clip_id", "w_start", "w_end"])

    return stream.groupBy("clip_id").applyInPandasWithState(step, "clip_id long, w_start int, w_end int", "tail array<int>, seen int, kept int", "append", GroupStateTimeout.NoTimeout)


def sliding_windows(stream: DataFrame, length: int, stride: int, gap_fill: int = 3) -> DataFrame:
    """clip_id, w_start, w_end: each full window as soon as a frame passes its end, the aligned last one at the run's end."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, due = state.get if state.exists else (None, None, None)
        frames, end = _ordered(batches)
        out: list[tuple] = []

        def close() -> None:
            nonlocal start
            at = max(start, last - length + 1)
            while due_ok():
                pass
            if not out or out[-1] != (key[0], at, min(at + length - 1, last)):
                out.append((key[0], at, min(at + length - 1, last)))
            start = None

        def due_ok() -> bool:
            """Emit the next full window, if the run has reached its end."""
            nonlocal due
            if due + length - 1 <= last:
                out.append((key[0], due, due + length - 1))
                due += stride
                return True
            return False

        for f in frames:
            if start is not None and f > last + 1 + gap_fill:
                close()
            if start is None:
                start = due = f
            last = f
            while due + length - 1 < last and due_ok():
                pass
        if end and start is not None:
            close()
        if start is not None:
            state.update((start, last, due))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["clip_id", "w_start", "w_end"])

    return stream.groupBy("clip_id").applyInPandasWithState(step, "clip_id long, w_start int, w_end int", "start int, last int, due int", "append", GroupStateTimeout.NoTimeout)


def tumbling_counts(events: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and tumbling window; later events than the watermark allows are left out."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("window.start", "window.end", "event_type", "n", "total")


def once_per_batch(df: DataFrame, path: str, checkpoint: str):
    """Write each micro-batch in folders of its number and clips, so that a repeated batch replaces what it wrote itself and nothing else."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "clip_id").parquet(path)

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
