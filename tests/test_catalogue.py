"""Every catalogue query against its SQL; views that must agree; the driver's contract."""

import pytest

from meterlake.plans import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, same, name):
    same(QUERIES[name](spark, D), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, D).count() > 0


def test_views_agree(spark):
    total = lambda name, c="tokens": sum(r[c] for r in QUERIES[name](spark, D).collect())
    tools = total("tool_summary")
    assert tools == total("model_distribution") == total("heatmap") == total("model_topk_other")


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
