"""Registered queries beside their SQL on the smallest data; ``QUANTGAP_ALL=1`` runs every one of them."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
# Cells of the smallest data are too thin for the fits (separated or collinear).
THIN = {"ols_trend", "ols_factors", "wls_cells", "logit_missing"}
QUICK = [
    "cell_summary", "w2_weighted", "w2_curve", "counterfactual_w2", "rendement_share", "bootstrap_ci", "chart_tiles",
    "nonresponse_balance", "bracket_imputation", "bracket_mid_percentile", "prepared_sample", "harmonised_waves",
    "early_waves", "value_labels", "occupation_class", "glm_interaction", "logit_labels", "path_differences",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [q for q in queries() if q not in THIN] if os.environ.get("QUANTGAP_ALL") else QUICK)
def test_query(spark, con, name):
    problem, _ = compare(spark, con, name, queries()[name], oracle_sql().get(name), FOLDER)
    assert problem is None, problem


def test_entry_and_registry(spark):
    assert entry(spark).limit(1).count() == 1
    assert set(oracle_sql()) <= set(queries())


def test_plan_reads_only_what_it_needs(spark):
    """Filters and columns reach the scan; the sex filter of a distance does not read unused columns."""
    from quantgap.plans.queries.base import sample

    plan = sample(spark, FOLDER).groupBy("sexe").count()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,0.0)" in plan
    assert "o_orderpriority" not in plan and "c_name" not in plan
