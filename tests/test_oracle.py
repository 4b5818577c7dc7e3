"""Layer 1: Spark queries against their DuckDB oracle (driver-style compare).

By default a representative subset runs at sf0.001; NETPRISM_FULL_ORACLE=1
runs every registered query with SQL at sf0.01 (slow).
"""

import os

import pytest

from tests.oracle_harness import compare, duck

FULL = os.environ.get("NETPRISM_FULL_ORACLE") == "1"
SF = "/root/testdata/sf0.01" if FULL else "/root/testdata/sf0.001"

SUBSET = [
    "P00_flagship_label_profile", "P02_missing_report", "P04_duplicate_stats", "P09_label_mapping",
    "C02_median_imputation", "C03_mode_imputation", "C13_key_duplicates_flag", "C15_forward_fill",
    "C17_winsorize_p99", "F05_flow_rate", "F16_interarrival_skewness", "F17_port_entropy",
    "W01_positional_groups", "W03_unique_destination_ports", "W11_previous_rows_stats",
    "L03_redundant_features", "L07_mutual_information", "E06_stratified_split_by_id",
    "E08_temporal_split", "V02_weighted_metrics", "V04_false_positive_rates", "R04_sample_with_normal",
    "X01_parse_json_lines", "X09_referer_kind", "B03_bigram_top100", "S04_discover_inputs",
    "Z02_sliding_windows",
]


def _keys():
    from netprism.plans import catalog

    catalog.load_all()
    return sorted(catalog.ORACLE) if FULL else SUBSET


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", _keys())
def test_matches_oracle(spark, con, key):
    from netprism.plans import catalog

    r = compare(spark, key, catalog.QUERIES[key], catalog.ORACLE[key], SF, con)
    assert r["status"] == "match", r


def test_every_query_has_an_id_prefix():
    from netprism.plans import catalog

    catalog.load_all()
    import re

    for k in catalog.QUERIES:
        assert re.match(r"^[A-Z]\d\d_[a-z0-9_]+$", k), k


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and set(df.columns) >= {"label", "n_flows"}
    assert set(e.oracle_sql()) <= set(e.queries())
