"""Queries that use the contests several times derive them once."""

import pytest

from duelframe.plans import load_all, q_entities, q_joins, standin

QUERIES = load_all()[0]


@pytest.mark.parametrize("name", ["B2_period_stakes", "B3_settle_bets", "J3_three_source_join"])
def test_result_reads_written_contests(spark, sf, name):
    """the lines were read anew for every use."""
    files = QUERIES[name](spark, sf).inputFiles()
    assert files and not any("lineitem" in f for f in files)


@pytest.mark.parametrize("name", ["J15_feature_join", "E5_frontier"])
def test_contests_are_derived_once(spark, sf, name, monkeypatch):
    """F40, F34."""
    calls, whole = [], standin.raw_contests
    for module in (standin, q_entities, q_joins):
        monkeypatch.setattr(module, "raw_contests", lambda *a: calls.append(1) or whole(*a))
    QUERIES[name](spark, sf)
    assert len(calls) == 1
