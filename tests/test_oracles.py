"""Every registered query with an SQL twin gives the same rows in both engines."""

import pytest
from compare import compare, connect

from uttera.catalog import REGISTRY


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql is not None])
def test_same_rows(spark, con, folder, name):
    ok, note = compare(spark, con, REGISTRY[name], folder)
    assert ok, note
