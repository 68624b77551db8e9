"""Registered queries against their SQL on the smallest tables; the full set is run by tools/check_oracle.py."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, canon

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables absent")
NAMES = ["h04_f02_flagship_fit_by_group", "h06_metrics", "h10_pareto_fitted_family", "b03_plan_lookup", "f05_residual_log", "c04_c05_optimal_grid", "c12_high_pass", "e02_k_nearest", "e23_trimmed_mean", "i06_early_stop", "i11_i12_timestep_weights", "g07_label_raster", "a16_audit"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
