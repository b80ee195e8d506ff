"""Work that costs far more than its rows is dealt out to all cores, however few files the rows come from."""

import pytest

from folioscope import catalog


@pytest.mark.parametrize("name", ["html_extracted", "check_verdicts", "fact_lines", "markdown_passed_through", "answer_tiers"])
def test_dealt_out(spark, sf_dir, name):
    found = catalog.queries()[name](spark, sf_dir)
    assert "RoundRobinPartitioning(4)" in found._jdf.queryExecution().executedPlan().toString()
