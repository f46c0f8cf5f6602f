"""Registered queries beside their SQL twins on the smallest tables.

A selection of every family runs by default; TREMOLITE_ALL=1 runs all of them.
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import TABLES, rows_of  # noqa: E402
from tremolite.plans import catalog  # noqa: E402

BASE = "/root/testdata/sf0.001"
SOME = """S01_time_scan S04_packed_bulletins P13_isolated_targets P14_systematic_sample T04_top_percent_cells A02_latest_snapshot A17_sessions
A21_sliding_b A32_roc_auc A38_distribution_summary A39_lag_correlation A41_permutation_null A52_alarm_skill J02_mechanism_lookup J03_space_time_window
J07_nearest_station J09_nearest_parent J13_neighbour_label J15b_asof_strict J17_stress_sum J24_missing_chunks W01_rolling_anomaly W08_window_counts
W11_gap_statistics W17_potential_score W24_common_mode W26_displacement_null U07_forward_fill U09_overlay G01_stress_map G05_sequence_trees
G13_reference_forecasts K02_upsert D05_publish_guard M05_permutation_importance R04_stream_sessions""".split()
NAMES = sorted(catalog.ORACLES) if os.environ.get("TREMOLITE_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BASE}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, BASE)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(catalog.ORACLES[name])
    want, wcols = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert cols == wcols and got == want


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
