"""Plans: no query pairs everything, and scans read only the columns that are needed."""

from __future__ import annotations

import re

import pytest

from sparkloupe.plans import catalogue

#: Queries that join one row of totals to all rows on purpose.
ONE_ROW = {"mapped_tests"}  # a broadcast aggregate of one row


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_no_query_pairs_everything(spark, sf, name):
    text = plan(catalogue.queries()[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text or name in ONE_ROW


@pytest.mark.parametrize(
    ("name", "columns"),
    [("rule_engine_counts", {"event_id"}), ("changed_line_semijoin", {"l_orderkey", "l_partkey", "l_linenumber", "l_quantity"}), ("numstat_churn", {"l_orderkey", "l_returnflag", "l_quantity", "l_linenumber"}), ("exact_duplicates", {"doc_id", "text"}), ("exclude_fnmatch", {"page_id", "url"}), ("knn_top3", {"vec_id", "embedding"})],
)
def test_scans_are_narrow(spark, sf, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)", plan(catalogue.queries()[name](spark, sf)))
    assert read and {c.split(":")[0] for part in read for c in part.split(",") if c} <= columns | {"element"}


def test_filters_reach_the_scan(spark, sf):
    text = plan(catalogue.queries()["changed_line_semijoin"](spark, sf))
    assert "GreaterThan(l_quantity,45.0)" in text
