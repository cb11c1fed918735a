"""Queries that SQL can express, value by value."""

import pytest

import __spark_entry__ as entry
import oracle_check
from basketlens.llm.sql import ORACLES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, folder, name):
    duck = oracle_check.connect(folder)
    assert oracle_check.differences(duck, entry.queries()[name](spark, folder), entry.oracle_sql()[name]) == []
