"""Reports over judged rows read and judge the texts once."""

import pytest

from textforge.plans import reporting


@pytest.mark.parametrize("query, scans", [(reporting.q_parity, 1), (reporting.q_rule_groups, 0)])
def test_texts_are_read_once(spark, sf, query, scans):
    """As columns of what is left to run: the rule groups' rows are written before."""
    plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "n_chars" in line for line in plan.splitlines()) == scans
