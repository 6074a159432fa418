"""Panels and market from one table of totals, and how often the line items are read."""

import datetime
import math

import pytest

from voltide import catalog, evaluations, studies
from voltide.sources import panels

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def passes(monkeypatch):
    """The calls of `panels.sales`, each of which is a pass over the line items."""
    made, sales = [], panels.sales
    monkeypatch.setattr(panels, "sales", lambda *args, **more: made.append(args) or sales(*args, **more))
    return made


def test_panels_do_not_read_the_line_items_again(spark):
    for df in (panels.prices(spark, DIR), panels.raw(spark, DIR), panels.market(spark, DIR), catalog.pairs(spark, DIR)):
        assert "l_shipdate" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["m_spike_evaluation", "m_index_spikes", "m_two_graphs", "g_evaluation_report"])
def test_line_items_are_read_once(spark, passes, monkeypatch, name):
    """Up to the distances a query has read the items once; what it goes on with is written."""
    given = []

    def distances(panel, *_):
        given.append(panel)
        raise InterruptedError

    monkeypatch.setattr(evaluations.gr, "distances", distances)
    with pytest.raises(InterruptedError):
        evaluations.QUERIES[name](spark, DIR)
    assert len(passes) == 1
    assert "l_shipdate" not in given[0]._jdf.queryExecution().optimizedPlan().toString()


def test_merged_predictions_read_the_line_items_once(spark, passes):
    df = studies.QUERIES["e_merged_predictions"](spark, DIR)
    assert len(passes) == 1
    assert "l_shipdate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_panels_and_market_from_totals(spark, tmp_path):
    """Items of a part without a brand belong to the market; missing prices and quantities do not count."""
    day = [datetime.datetime(2020, 1, n) for n in (1, 2, 3)]
    items = [(1, 1, 1, day[0], 10.0, 2.0), (1, 2, 2, day[0], 30.0, 3.0), (2, 1, 1, day[1], 16.0, 2.0), (2, 2, 1, day[1], None, 2.0), (3, 1, 3, day[1], 12.0, 3.0), (4, 1, 2, day[2], 9.0, 1.0), (5, 1, 9, day[2], 99.0, 1.0)]
    kinds = "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double"
    spark.createDataFrame(items, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    sold = panels.totals(spark, str(tmp_path))
    got = {(r["series"], r["i"]): r["px"] for r in panels.prices(spark, str(tmp_path), sold=sold).where("series is not null").collect()}
    assert got == {("a", 1): 5.0, ("a", 2): 4.0, ("a", 3): 4.0, ("b", 1): 10.0, ("b", 2): 10.0, ("b", 3): 9.0}
    got = [r["Market_Returns"] for r in panels.market(spark, str(tmp_path), sold=sold).orderBy("dt").collect()]
    assert got == pytest.approx([100 * math.log(4 / 8), 100 * math.log(9 / 4)])
