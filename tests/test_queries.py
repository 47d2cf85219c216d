"""Every registered query against its SQL counterpart, on the smallest tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from tools.check import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    pytest.importorskip("duckdb")
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_its_sql(spark, connection, name):
    assert compare(spark, connection, name, SF, queries()[name], oracle_sql().get(name)) is None


def test_entry(spark):
    assert entry(spark).count() == 10
    assert set(oracle_sql()) <= set(queries())


def test_events_of_the_larger_tables(spark):
    """Counts known from the view definition."""
    found = {r["event_type"]: r["n"] for r in queries()["event_type_histogram"](spark, "/root/testdata/sf0.01").collect()}
    assert found == {
        "ABERTURA_CONFIRMADA": 1323,
        "PRIMEIRA_OBSERVACAO": 10953,
        "MUDANCA_CATEGORIA": 1288,
        "DESAPARECIMENTO": 12451,
    }
