"""Plan checks: no Python evaluation and no cartesian product in core plans;
filters reach the parquet scan."""
import pytest

import __spark_entry__ as E
from tests.conftest import SF

CORE = ["exact_match", "market_benchmark", "selling_intelligence", "leaderboards", "stock_sales_cohorts",
        "stone_sell_through", "decision_matrix", "live_market_cells", "range_color_clarity_matrix", "carat_matrix"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CORE)
def test_no_python_no_cartesian(spark, name):
    p = plan(E.queries()[name](spark, SF))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "CartesianProduct" not in p


def test_feed_filter_pushed(spark):
    from facetwise.sources import feeds
    p = plan(feeds.market_feed(spark, SF))
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,N)" in p


def test_leaderboards_group_limit(spark):
    from facetwise.plans import base
    from facetwise.operators import selling
    df = selling.leaderboards(base.matched(spark, SF), 10, base.TIEBREAK)
    assert "WindowGroupLimit" in plan(df)
