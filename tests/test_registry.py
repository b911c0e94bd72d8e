"""Registered queries: twins exist, and a spread of them agrees with DuckDB at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import oracle  # noqa: E402

from pricetide.plans import registry  # noqa: E402

registry.load_all()
SF = "/root/testdata/sf0.001"
SPREAD = ["ag1_region_summary", "ag5_ew_median", "ag8_pools", "prj3_normalize_lot", "jn1_match_address", "jn13_observations_asof", "wn1_rank_candidates",
          "dq4_overlapping_sources", "st2_ledger", "se4_poll_delta", "ui6_growth_ranking", "snk5_publish_bundle"]


FITTED = {
    "ml1_fit_residual", "ml2_walk_forward", "ml3_tune", "ml4_fit_quantiles", "ml5_calibrate", "ml6_fit_radius", "ml7_fit_growth", "ml8_evaluate_origins",
    "ml9_permutation_importance", "ml10_predict_current", "ml11_correction_grid",
}


def test_every_query_but_those_of_fitted_models_has_a_twin():
    assert {n for n in registry.QUERIES if n not in registry.ORACLES} == FITTED


def test_entry_returns_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SPREAD)
def test_query_agrees_with_its_twin(spark, name):
    con = oracle.connect(SF)
    df = registry.QUERIES[name](spark, SF)
    cur = con.execute(registry.ORACLES[name])
    assert oracle.compare(df.collect(), df.columns, cur.fetchall(), [d[0] for d in cur.description]) is None
