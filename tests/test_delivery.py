"""Aliases, schemas, sinks and scorers on small tables."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskloom.functions import aliases, variants
from maskloom.functions import text as T
from maskloom.operators import scoring
from maskloom.sources import files, schemas


def test_the_last_group_of_an_alias_counts_and_files_can_be_read(spark, tmp_path):
    groups = [
        {"canonical": "Alpha", "strict_aliases": ["A.", "ALPHA"], "review_aliases": ["First"]},
        {"canonical": "Beta", "strict_aliases": ["a", "B"], "review_aliases": []},
    ]
    (tmp_path / "aliases.json").write_text(json.dumps({"groups": groups}))
    index = aliases.index(aliases.resource(spark, str(tmp_path / "aliases.json")))
    found = {r["key"]: (r["strict"], r["review"]) for r in index.collect()}
    assert found["a"] == (["a", "B"], []) and found["alpha"] == (["A.", "ALPHA"], ["First"]) and found["first"][1] == ["First"]
    rows = spark.createDataFrame([("alpha",), ("b",), ("none",), (None,)], "s string")
    got = {r["s"]: (r["strict"], r["review"]) for r in aliases.alias_candidates(rows, F.col("s"), index).collect()}
    assert got == {"alpha": (["A."], ["First"]), "b": (["a"], []), "none": ([], []), None: ([], [])}


@pytest.mark.parametrize("surface, want", [
    ("March 1", ["March 2"]), ("0", ["1", "10"]), ("1999", ["1998", "2000"]), ("1,200 people", ["1,320 people", "1,080 people"]), ("2.5 miles", ["3.50 miles", "1.50 miles"]),
    ("$25", ["$27", "$23", "€25"]), ("none", []), ("3", ["4", "2"]),
])
def test_perturbed_values(spark, surface, want):
    assert spark.createDataFrame([(surface,)], "s string").select(variants.perturbed(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("surface, kind, want", [
    ("seventeen", "CARDINAL", ["eighteen"]), ("31", "DATE", ["30"]), ("12%", "PERCENT", ["11%", "13%"]), ("4.5", "CARDINAL", ["3.5", "5.5"]), ("$1,000", "MONEY", ["$900", "$1,100", "€1,000"]),
])
def test_changed_values(spark, surface, kind, want):
    assert spark.createDataFrame([(surface, kind)], "s string, k string").select(variants.changed(F.col("s"), F.col("k"))).first()[0] == want


def test_equivalent_values(spark):
    rows = [("1,2,3", "CARDINAL"), ("5.0", "CARDINAL"), ("7%", "PERCENT"), ("7 per cent", "PERCENT"), ("£3", "MONEY"), ("March 3", "DATE"), ("Sept. 3", "DATE"), (None, "DATE")]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, k string").coalesce(1).select(variants.equivalents(F.col("s"), F.col("k"))).collect()]
    assert got[:7] == [["123"], ["5"], ["7 percent", "7 per cent"], ["7%"], ["3 pounds"], ["Mar. 3"], ["September 3"]]


def test_matching_occurrence_takes_the_one_that_fits(spark):
    df = spark.createDataFrame([("a cat and a cat", "cat", "dog", "a cat and a dog")], "x string, n string, v string, t string")
    assert df.select(T.matching_occurrence(*[F.col(c) for c in "xnvt"])).first()[0] == "a cat and a dog"


def test_differing_span_of_long_texts(spark):
    a, b = "x" * 20000 + "left" + "y" * 20000, "x" * 20000 + "other" + "y" * 20000
    got = spark.createDataFrame([(a, b), ("", "q"), ("aa", "aaa"), ("same", "same")], "a string, b string").coalesce(1).select(T.differing_span(F.col("a"), F.col("b")).alias("d")).collect()
    assert [tuple(r["d"]) for r in got] == [("left", "other"), ("", "q"), ("", "a"), ("", "")]


def test_tables_are_created_once_and_reset(spark, tmp_path):
    folder = str(tmp_path / "inventory")
    made = schemas.create(spark, folder)
    assert set(made) == set(schemas.SCHEMAS) and all(df.count() == 0 for df in made.values())
    spark.createDataFrame([("a", "1")], schemas.SCHEMAS["run_metadata"]).write.mode("overwrite").parquet(f"{folder}/run_metadata.parquet")
    assert schemas.create(spark, folder)["run_metadata"].count() == 1 and schemas.create(spark, folder, reset=True)["run_metadata"].count() == 0


def test_splits_metadata_and_parts(spark, tmp_path):
    rows = spark.createDataFrame([(i, "review" if i % 2 else "train") for i in range(40)], "id long, split string")
    files.write_splits(rows, str(tmp_path / "s"), reviewed=5)
    back = spark.read.schema("id long, split string").json(str(tmp_path / "s"))
    assert {r["split"]: r["count"] for r in back.groupBy("split").count().collect()} == {"train": 20, "review": 5}
    files.write_metadata(spark, str(tmp_path / "m"), {"a": "1", "b": "2"})
    files.write_metadata(spark, str(tmp_path / "m"), {"b": "3"})
    assert {r["key"]: r["value"] for r in spark.read.json(str(tmp_path / "m")).collect()} == {"a": "1", "b": "3"}
    one = sorted(map(tuple, files.split_round_robin(rows, "id", 3).select("id", "part").collect()))
    assert one == sorted(map(tuple, files.split_round_robin(rows.repartition(5), "id", 3).select("id", "part").collect()))


def test_answers_in_both_shapes(spark):
    rows = [(1, '```json\n{"results": [{"pair_id": "a", "label": "Changed"}]}\n```'), (2, 'Sure: {"b": "preserved", "c": "maybe"}'), (3, "none"), (4, None)]
    got = {(r["k"], r["pair_id"], r["label"], r["score"]) for r in files.parsed_judgments(spark.createDataFrame(rows, "k long, content string"), "k", "content").collect()}
    assert got == {(1, "a", "changed", 0.0), (2, "b", "preserved", 1.0)}


def test_calls_are_repeated_batched_and_resumed(spark):
    waits, left = [], [2]

    def call(batch):
        if left[0]:
            left[0] -= 1
            raise OSError
        return batch

    frame = pd.DataFrame({"id": [1, 2, 3]})
    assert len(scoring.retried(call, sleep=waits.append)(frame)) == 3 and waits == [1.0, 2.0]
    with pytest.raises(ZeroDivisionError):
        scoring.retried(lambda b: 1 / 0, attempts=2, sleep=waits.append)(frame)
    assert scoring.in_batches(lambda b: b if 2 not in set(b["id"]) else 1 / 0, 1)(frame)["id"].tolist() == [1, 3]
    rows, done = spark.range(6), spark.range(2)
    assert scoring.resumed(rows, done, "id", lambda: lambda b: b, "id long").count() == 4
    warned = scoring.alignment_warnings(
        spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, s string"), spark.createDataFrame([(1, "a"), (2, "x"), (2, "x"), (9, "z")], "id long, s string"), "id", "s"
    )
    assert {tuple(r) for r in warned.collect()} == {(2, "duplicate_answer"), (2, "surface_repaired"), (3, "missing_answer"), (9, "unknown_id")}


def test_the_subpackage_may_lack_something(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    real = importlib.import_module

    def broken(name, *rest):
        if name.startswith("maskloom.llm"):
            raise ModuleNotFoundError("xxhash", name="xxhash")
        return real(name, *rest)

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    assert "p1_found" in entry.queries() and "p2_found" not in entry.queries()
