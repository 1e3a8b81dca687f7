"""Queries of this subpackage that have SQL give the same rows in Spark and DuckDB."""

from __future__ import annotations

import pytest

from dipfold.llm import registry
from tests.oracle import difference


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_same_as_sql(spark, small, name):
    assert difference(spark, registry.queries()[name], registry.oracles()[name], small) == ""
