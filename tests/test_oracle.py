"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry
from tidemark import catalog

SF = "/root/testdata/sf0.001"
NO_TWIN: set[str] = set()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_a_twin_unless_it_draws_at_random():
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == NO_TWIN
    assert set(catalog.ORACLE) <= set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    ok, text = compare(spark, duck, name, SF)
    assert ok, text


def test_entry_gives_one_row_per_horizon(spark):
    assert entry.entry(spark).count() == 6
