"""Registered queries against their SQL twins on the smallest tables.

The default run takes a cross-section; NAVLYTICS_TEST_ALL=1 runs every query that has SQL.
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracle import TABLES, compare  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = """track_length_histogram track_percentiles robust_mean_by_group asof_measurement clock_repair invalid_range_filter
session_reset dense_renumbering track_spacing_filter grid_topk landmark_sanity mutual_nn_match shared_track_pairs nan_box_mean
quaternion_algebra camera_projection geodetic_enu label_scan dataset_observations landmark_triangulation""".split()
NAMES = sorted(oracle_sql()) if os.environ.get("NAVLYTICS_TEST_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    got = queries()[name](spark, SF).toPandas()
    want = duck.execute(oracle_sql()[name]).df()
    assert compare(got, want).startswith("ok"), compare(got, want)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
