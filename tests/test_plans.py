"""Physical plans: no quadratic joins, pushed filters, pruned columns, top-k without a full sort."""

import os

import pytest

from tallyworks import queries  # noqa: F401
from tallyworks.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_quadratic_join(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(("name", "parts"), [
    ("retention_14d", ["PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,", "ReadSchema: struct<ts:timestamp_ntz,event_type:string>"]),
    ("latest_scan", ["TakeOrderedAndProject"]),
    ("eod_digest", ["TakeOrderedAndProject", "PushedFilters: [IsNotNull(ts)"]),
    ("daily_ranking", ["WindowGroupLimit"]),
    ("verified_anti", ["LeftAnti", "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>"]),
    ("blocked_semi", ["LeftSemi"]),
    ("url_fingerprint", ["ReadSchema: struct<page_id:bigint,url:string>"]),
])
def test_plan_has(spark, name, parts):
    text = plan(QUERIES[name](spark, SF))
    for p in parts:
        assert p in text, text
