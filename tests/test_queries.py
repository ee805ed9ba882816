"""Every query outside the llm subpackage against its SQL, on the smallest tables."""

import pytest
from conftest import DATA
from oracle import compare

import __spark_entry__ as entry

NAMES = sorted(n for n in entry.oracle_sql() if not entry.queries()[n].__module__.startswith("maskloom.llm"))


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, name):
    folder = f"{DATA}/sf0.001"
    alike, extra, lacking = compare(entry.queries()[name](spark, folder), entry.oracle_sql()[name], folder)
    assert alike and not extra and not lacking, (extra[:5], lacking[:5])


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
