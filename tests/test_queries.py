"""Every query of the core against its SQL, and the entry point."""

from __future__ import annotations

import pytest
from domainloom.plans import catalogue

from oracle import compare, connect


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, small, name):
    query, sql = catalogue.queries()[name], catalogue.oracle_sql().get(name)
    if sql is None:
        assert query(spark, small).count() > 0
    else:
        assert compare(spark, con, query, sql, small) == ""


def test_entry(spark, small):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_core_does_not_import_llm():
    from pathlib import Path

    import domainloom

    root = Path(domainloom.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "domainloom.llm" not in f.read_text() and "from .llm" not in f.read_text() and "from ..llm" not in f.read_text(), f
