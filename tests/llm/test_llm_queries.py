"""The subpackage's queries over whole small tables: with SQL where there is some, else their form."""

import pytest
from conftest import DATA
from oracle import compare

from maskloom.llm.queries import QUERIES, SQL

FORMS = {
    "p2_found": {"name_a", "name_b"}, "p3_found": {"pair_id", "label"}, "p4_found": {"text_id_a", "text_id_b"}, "p5_found": {"text_id", "group_id"},
    "p6_found": {"text_id_a", "text_id_b"}, "p8_found": {"doc_id", "item_id"}, "p9_found": {"doc_id", "subject"},
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    folder = f"{DATA}/sf0.001"
    alike, extra, lacking = compare(QUERIES[name](spark, folder), SQL[name], folder)
    assert alike and not extra and not lacking, (extra[:5], lacking[:5])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    rows = df.collect()
    if name in FORMS:
        assert set(df.columns) == FORMS[name] and len(rows) == len(set(rows))
    if name in ("p2_found", "p4_found", "p6_found"):
        assert all(r[0] < r[1] for r in rows)
