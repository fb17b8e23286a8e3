"""The corpus queries that have SQL, against it, over whole tables."""

from __future__ import annotations

import oracle
import pytest

from tallyframe.llm import queries as Q


@pytest.mark.parametrize("key", sorted(Q.oracle_sql()))
def test_matches_sql(key, spark, sf_dir):
    assert oracle.compare(Q.queries()[key](spark, sf_dir), oracle.connect(sf_dir), Q.oracle_sql()[key]) is None
