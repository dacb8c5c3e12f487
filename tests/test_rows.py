"""Queries whose result would say nothing if it were empty have rows on the smallest tables."""

import pytest

import __spark_entry__ as entry

LEAST = {"J6_few": 5, "W2_rare": 10, "W3_rare": 20, "O21_rare": 5, "O25_changes": 20, "SNK13_rows": 100, "G3_all": 500, "J7": 20, "SET_except": 50, "N1_outlines": 100, "O9_checks": 5}


@pytest.mark.parametrize("name", sorted(LEAST))
def test_has_rows(spark, name):
    rows = entry.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) >= LEAST[name]
    if name == "O25_changes":
        assert any(r["recall_change"] for r in rows) and any(r["fdr_change"] for r in rows)
    if name == "G3_all":
        assert any(r["apart"] for r in rows) and any(r["total"] for r in rows)
