"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from filmloom.plans.queries import QUERIES, SQL


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else int(v) if isinstance(v, bool) else v


def rows(frame):
    columns = sorted(frame.columns)
    return Counter(tuple(plain(v) for v in r) for r in frame[columns].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, data, name):
    got, want = QUERIES[name](spark, data).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_merge_keeps_the_first_box_and_the_best_score(spark):
    from filmloom.operators import tracks

    df = spark.createDataFrame(
        [(1, 0, 1, 0, 0, 10, 10, 0.4), (1, 0, 2, 1, 0, 11, 10, 0.9), (1, 0, 3, 40, 0, 50, 10, 0.5)],
        "clip_id long, frame_idx long, det_id long, x0 long, y0 long, x1 long, y1 long, score double",
    )
    got = {(r.x0, r.x1): r.score for r in tracks.merge(df, ["clip_id", "frame_idx"], ["det_id"]).collect()}
    assert got == {(0, 10): 0.9, (40, 50): 0.5}
