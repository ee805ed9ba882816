"""Physical plans: what is read, what is shuffled, what stays out of Python."""

import re

import pytest
from conftest import DATA

import __spark_entry__ as entry

NATIVE = ["p1_deliveries", "a01_inventory", "a12_consensus", "j01_star", "j18_ranking", "a21_coverage", "t14_crop", "n01_perturb", "a14_binary_metrics", "f01_reject_reasons"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_in_the_plan(spark, name):
    assert not re.search("ArrowEvalPython|BatchEvalPython|MapInPandas|PythonUDF|CartesianProduct", plan(entry.queries()[name](spark, f"{DATA}/sf0.001")))


def test_only_needed_columns_are_read(spark):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(entry.queries()["p1_found"](spark, f"{DATA}/sf0.001")))
    assert {"id:bigint,entity_id:bigint", "id:bigint,mention_count:bigint"} == set(read)


def test_filters_reach_the_scan(spark):
    text = plan(entry.queries()["t27_signature"](spark, f"{DATA}/sf0.001"))
    assert "EqualTo(heuristic_group,numeric)" in text


def test_counts_are_combined_before_each_shuffle(spark):
    text = plan(entry.queries()["p1_found"](spark, f"{DATA}/sf0.001"))
    assert text.count("partial_bit_or") == 1 and text.count("partial_sum") == 1


def test_top_rows_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["w03_topn_mentions"](spark, f"{DATA}/sf0.001"))
