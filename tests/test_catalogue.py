"""Every registered query with SQL against DuckDB on the smallest tables; the others give a schema and rows."""

import math

import duckdb
import pytest

from framewright.operators import export as X
from framewright.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name in ORACLES:
        r = duck.sql(ORACLES[name])
        names = list(r.columns)
        assert sorted(names) == cols
        assert got == sorted(tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall())
    else:
        assert len(set(cols)) == len(cols)


def agrees(spark, name, sf, tables):
    """A query on other tables against its SQL."""
    c = duckdb.connect()
    for t in tables:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    r = c.sql(ORACLES[name])
    cols = sorted(r.columns)
    got = sorted(tuple(norm(x[k]) for k in cols) for x in QUERIES[name](spark, str(sf)).collect())
    assert got == sorted(tuple(norm(x[r.columns.index(k)]) for k in cols) for x in r.fetchall())
    return got


@pytest.mark.parametrize("name", ["weighted_side_vote", "evidence_rank"])
def test_votes_without_weight(spark, tmp_path, name):
    """Tracks whose weights are all zero, cancel out or are null, beside a plain one."""
    rows = [(1, 0, 0.0), (1, 1, 0.0), (2, 2, 5.0), (2, 4, -5.0), (2, 700, 0.0), (3, 5, None), (3, 800, 0.0), (3, 6000, 40.0), (4, 8, 30.0), (4, 9, 20.0)]
    values = ", ".join(f"({u}, {i}, {'NULL' if v is None else v}::DOUBLE)" for u, i, v in rows)
    at = "timestamp '2024-01-01' + to_hours(event_id) AS ts"
    duckdb.sql(f"copy (select user_id::BIGINT AS user_id, event_id::BIGINT AS event_id, {at}, value from (values {values}) v(user_id, event_id, value)) to '{tmp_path}/events.parquet' (format parquet)")
    assert len(agrees(spark, name, tmp_path, ["events"])) == 7


@pytest.mark.parametrize("name", ["weighted_side_vote", "evidence_rank"])
def test_votes_before_the_first_day(spark, tmp_path, name):
    """Frames of negative numbers fall into tracks as the SQL's integer division has them, -9 to 9 into one."""
    duckdb.sql(f"copy (select 1::BIGINT AS user_id, i::BIGINT AS event_id, timestamp '2023-12-20' + to_hours(CAST(i * 5 AS INTEGER)) AS ts, 10.0 + i AS value from range(100) t(i)) to '{tmp_path}/events.parquet' (format parquet)")
    assert len(agrees(spark, name, tmp_path, ["events"])) == 8


def test_paths_beyond_a_million_episodes(spark, tmp_path):
    """The query cuts numbers as its SQL does; the operator's own paths stay apart."""
    duckdb.sql(f"copy (select i AS l_orderkey, 'A' AS l_returnflag, i AS l_suppkey from range(1000003) r(i)) to '{tmp_path}/lineitem.parquet' (format parquet)")
    got = agrees(spark, "episode_paths", tmp_path, ["lineitem"])
    assert ("1000002", "data/chunk-100/episode_100000.parquet") in got
    own = X.paths(spark.createDataFrame([(100000,), (1000002,)], "episode_index long")).collect()
    assert [r["path"] for r in own] == ["data/chunk-100/episode_100000.parquet", "data/chunk-1000/episode_1000002.parquet"]


def test_means_of_an_episode_are_summed_in_order(spark, tmp_path):
    """Means that differ in the last bit by the order of their sums lie on both sides of the percentile; lines stand in the file in another order than in their episodes."""
    mean = lambda x: (x[0] + x[1] + x[2]) / 3
    low, high = sorted([(0.01, 0.02, 0.04), (0.04, 0.02, 0.01)], key=mean)
    assert mean(low) < mean(high)
    rows = [(e, 3 - i, x) for e in range(200) for i, x in enumerate((high if e == 77 else low)[::-1])]
    values = ", ".join(map(str, rows))
    more = "1 AS l_partkey, 1 AS l_suppkey, l_linenumber::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, 'A' AS l_returnflag, timestamp '2024-01-01' AS l_shipdate"
    duckdb.sql(f"copy (select l_orderkey::BIGINT AS l_orderkey, l_linenumber, l_tax::DOUBLE AS l_tax, {more} from (values {values}) v(l_orderkey, l_linenumber, l_tax)) to '{tmp_path}/lineitem.parquet' (format parquet)")
    assert len(agrees(spark, "exported_dataset", tmp_path, ["lineitem"])) == 597
