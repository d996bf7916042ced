"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: SQL of the frame-like tables (DuckDB), for WITH clauses.
FRAMES = "fr AS (SELECT user_id AS clip_id, CAST((epoch_us(ts) - 1704067200000000) // 21600000000 AS INTEGER) AS frame_id, min(event_id) AS event_id, max(value) AS value, count(*) AS n FROM events GROUP BY 1, 2)"
LONG = "fr AS (SELECT user_id % 10 AS clip_id, CAST((epoch_us(ts) - 1704067200000000) // 3600000000 AS INTEGER) AS frame_id, min(event_id) AS event_id, max(value) AS value, count(*) AS n FROM events GROUP BY 1, 2)"
RUNS = """g AS (SELECT *, CASE WHEN frame_id <= lag(frame_id) OVER (PARTITION BY clip_id ORDER BY frame_id) + 4 THEN 0 ELSE 1 END AS f FROM fr),
s AS (SELECT *, CAST(sum(f) OVER (PARTITION BY clip_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM g),
runs AS (SELECT clip_id, run_id, min(frame_id) AS start_frame, max(frame_id) AS end_frame, count(*) AS n_frames FROM s GROUP BY 1, 2)"""
DET = """det AS (SELECT user_id AS clip_id, CAST((epoch_us(ts) - 1704067200000000) // 21600000000 AS INTEGER) AS frame_id, event_id,
CAST(row_number() OVER (PARTITION BY user_id, (epoch_us(ts) - 1704067200000000) // 21600000000 ORDER BY event_id) - 1 AS INTEGER) AS hand_idx,
CAST(event_id % 2 AS INTEGER) AS side, value / 500 AS conf, CAST(event_id * 37 % 400 AS DOUBLE) AS x1, CAST(event_id * 53 % 300 AS DOUBLE) AS y1,
CAST(event_id * 37 % 400 + (event_id % 11 - 2) * 10 AS DOUBLE) AS x2, CAST(event_id * 53 % 300 + (event_id % 7 - 1) * 12 AS DOUBLE) AS y2 FROM events)"""
EP = "ep AS (SELECT l_orderkey AS episode, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS INTEGER) AS t, * FROM lineitem)"


def query(sql: str | None = None, name: str | None = None):
    """Register a function (spark, sf_dir) under its name, with SQL where there is any."""

    def add(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add
