"""Every query with an SQL twin gives the twin's rows; the others run and give rows of a stable shape."""

from __future__ import annotations

import oracle
import pytest
from tallyfield import catalog


@pytest.fixture(scope="module")
def con(tiny):
    return oracle.connection(tiny)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, tiny, con, name):
    assert oracle.difference(spark, con, catalog.QUERIES[name], catalog.ORACLE[name], tiny) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, tiny, name):
    assert catalog.QUERIES[name](spark, tiny).collect() is not None
