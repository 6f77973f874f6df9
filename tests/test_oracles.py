"""Every registered query against its SQL twin on the smallest tables."""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"
def own(names):
    return {k: v for k, v in names.items() if not re.match(r"op\d+_|pipeline$", k)}


SQL = own(entry.oracle_sql())
QUERIES = own(entry.queries())
# no positive label at this size, so these are empty there
EMPTY = {"roc_points", "precision_at_k", "top_k_precision", "detection_report"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_names_agree():
    assert set(SQL) <= set(QUERIES)
    assert sorted(set(QUERIES) - set(SQL)) == [
        "detector_quality", "full_run", "iforest_scores", "permutation_importance", "recon_scores"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert {"user", "max_risk_score", "risk_tier", "trend"} <= set(df.columns)
    assert df.count() > 0
