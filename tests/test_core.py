import collections
import random

import pytest
from pyspark.sql import functions as F

from maskloom.operators import components, skew, vectors
from maskloom.sources import files


def test_distinct_per_key_ignores_redelivery_nulls_and_extra_columns(spark):
    rows = [(1, 5, "k"), (1, 5, "k"), (1, -7, "k"), (1, 70, None), (2, None, "x"), (None, 3, "x"), (3, 1 << 40, "y")]
    df = spark.createDataFrame(rows, "key long, item long, word string")
    got = {r["key"]: r["n_distinct"] for r in skew.distinct_per_key(df, "key", "item").collect()}
    assert got == {1: 3, 3: 1}
    text = df.select("key", F.col("item").cast("string").alias("item"), "word")
    assert {r["key"]: r["n_distinct"] for r in skew.distinct_per_key(text, "key", "item").collect()} == got
    assert skew.distinct_per_key(df.limit(0), "key", "item").count() == 0


def test_stale_counts(spark):
    owners = spark.createDataFrame([(1, 2), (2, 0), (3, None), (4, 1), (None, 0)], "id long, mention_count long")
    rows = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (4, 12), (4, 13)], "entity_id long, id long")
    found = skew.stale_counts(owners, "id", "mention_count", rows, "entity_id", "id").collect()
    assert {(r["owner"], r["claimed"], r["n_distinct"]) for r in found} == {(3, None, 0), (4, 1, 2)}


def test_lookup_gives_the_plain_join_for_hot_and_cold_keys(spark):
    keys = [7] * 3000 + list(range(100, 160))
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    by = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    got = {(r["k"], r["i"], r["v"]) for r in skew.lookup(rows, by, "k", "n", share=0.1).collect()}
    assert got == {(k, i, 2 * k) for i, k in enumerate(keys)}


@pytest.mark.parametrize("at_once", [0, 1000])
def test_components_against_union_find(spark, at_once):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)]
    edges += [(5000, i) for i in range(6000, 6300)] + [(3, 3), (3, None), (None, 4)] + [(7, 8), (8, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = collections.defaultdict(set)
    for x in list(parent):
        groups[root(x)].add(x)
    want = {(x, min(g)) for g in groups.values() for x in g}
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {tuple(r) for r in components.connected_components(df, at_once=at_once).collect()} == want
    assert components.connected_components(df.limit(0), at_once=at_once).count() == 0


def test_top_k_takes_ties_by_id_and_leaves_out_the_query(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = vectors.top_k(df.where("id IN (1, 5)"), df, "id", "v", 3).orderBy("rank").collect()
    assert [(r["query"], r["id"], r["cosine"]) for r in got] == [(1, 2, 1.0), (1, 3, 1.0), (1, 4, 0.0)]
    small = vectors.top_k(df.where("id < 5"), df, "id", "v", 1, block=1)
    assert {(r["query"], r["id"]) for r in small.collect()} == {(1, 2), (2, 1), (3, 1), (4, 1)}


def test_jsonl_round_trip_and_resume(spark, tmp_path):
    path = str(tmp_path / "rows")
    df = spark.createDataFrame([(1, "ä|b"), (2, None)], "id long, x string")
    files.write_jsonl(df, path)
    files.append_new(spark.createDataFrame([(2, "again"), (3, "new")], "id long, x string"), path, "id")
    got = files.read_jsonl(spark, path, "id long, x string")
    assert sorted((r["id"], r["x"]) for r in got.collect()) == [(1, "ä|b"), (2, None), (3, "new")]
    assert files.read_if_there(spark, str(tmp_path / "none"), "id long").count() == 0
    both = files.named_inputs(spark, [f"a={path}", path], "id long, x string")
    assert {r["corpus_source"] for r in both.collect()} == {"a", "rows"}
    assert files.markdown(got, "x", 1, F.col("id")).count("## ") == 3
    assert '"rows":3' in files.manifest(got, ["x"]).first()["manifest"]


def test_arrow_shards(spark, tmp_path):
    import pyarrow as pa

    from maskloom.sources import arrow_shards

    for k, kind in enumerate((pa.ipc.new_stream, pa.ipc.new_file)):
        t = pa.table({"masked_text": [f"t{k}{i}" for i in range(3)], "demasked_words": [["a", "b"], [], None]})
        with pa.OSFile(str(tmp_path / f"data-{k:05d}.arrow"), "wb") as out, kind(out, t.schema) as writer:
            writer.write_table(t)
    arrow_shards.register(spark)
    schema = "row_idx long, masked_text string, demasked_words array<string>, title string"
    rows = spark.read.format("arrow_shards").schema(schema).load(str(tmp_path)).orderBy("row_idx").collect()
    assert [(r["row_idx"], r["masked_text"], r["title"]) for r in rows][2:4] == [(2, "t02", None), (3, "t10", None)]
    assert rows[0]["demasked_words"] == ["a", "b"] and len(rows) == 6
    assert spark.read.format("arrow_shards").schema(schema).option("max_rows", "4").load(str(tmp_path)).count() == 4


def test_streaming_consensus_equals_batch(spark, tmp_path):
    from maskloom.operators import judging
    from maskloom.streaming import votes

    folder = str(tmp_path / "in")
    rows = [(1, "p1", "a", "preserved"), (2, "p1", "b", "Preserved "), (2, "p1", "b", "Preserved "), (3, "p2", "a", "changed"), (4, "p2", "b", "preserved"), (5, "p3", "a", None)]
    df = spark.createDataFrame(rows, "judgment_id long, pair_id string, annotator_id string, label string").withColumn("received_at", F.lit("2025-01-01").cast("timestamp")).withColumn("score", F.lit(0.5))
    df.write.parquet(folder)
    stream = votes.running_consensus(spark.readStream.schema(df.schema).parquet(folder))
    query = stream.writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["pair_id"], r["label"]) for r in spark.table("running").collect()}
    batch = {(r["pair_id"], r["label"]) for r in judging.consensus(judging.votes(df)).collect()}
    assert got == batch == {("p1", "preserved"), ("p2", "uncertain"), ("p3", "uncertain")}


def test_scorer_is_made_per_task_and_missing_answers_are_named(spark):
    from maskloom.operators import scoring

    rows = spark.createDataFrame([(1, "a"), (2, "bb")], "id long, x string")

    def make():
        return lambda batch: batch.assign(n=batch["x"].str.len())[["id", "n"]]

    assert {tuple(r) for r in scoring.scored(rows, make, "id long, n long").collect()} == {(1, 1), (2, 2)}
    answers = spark.createDataFrame([(1, "yes")], "id long, said string")
    assert {(r["id"], r["said"]) for r in scoring.asked(rows, answers, "id", "said").collect()} == {(1, "yes"), (2, "missing")}


def test_proper_pool_loses_no_common_word(spark):
    from itertools import product

    from maskloom.operators.generate import proper_pool

    surfaces = [f"First{i} Smith" for i in range(60)] + [f"First{i} Middle{i % 4} Smith Jones" for i in range(40)] + ["Smith", "Jones Smith", "..."]
    surfaces += [" ".join(f"Word{k}" for k in range(n)) + " Smith" for n in (7, 8, 11)] + ["Word1 Word2", "Word1 Word2"]
    rows = [(i, x, "proper_name", "PERSON" if i % 9 else "ORG") for i, x in enumerate(surfaces)] + [(900, "Smith", "numeric", "PERSON"), (901, "Smith", "proper_name", None)]
    got = {tuple(r) for r in proper_pool(spark.createDataFrame(rows, "id long, surface string, heuristic_group string, heuristic_type string")).collect()}
    named = [(i, set(x.lower().split()) - {"..."}, t) for i, x, g, t in rows if g == "proper_name" and t]
    best = {}
    for (a, x, t), (b, y, u) in product(named, named):
        if a != b and t == u and x & y and round(len(x & y) / len(x | y), 6) >= 0.18:
            best.setdefault(a, []).append((-round(len(x & y) / len(x | y), 6), b))
    assert got == {(a, b, -s, r) for a, found in best.items() for r, (s, b) in enumerate(sorted(found)[:3], 1)}
    assert len(best) > 100


def test_a_hot_key_is_spread_over_all_tasks(spark):
    rows = spark.range(40000).repartition(8).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"))
    by = rows.select("k").distinct().withColumn("name", F.concat(F.lit("n"), "k"))
    out = skew.spread_join(rows, by, "k")
    assert out.count() == 40000 and out.where("name <> concat('n', k)").count() == 0
    hot = [r["count"] for r in out.where("k = 0").groupBy(F.spark_partition_id()).count().collect()]
    assert len(hot) >= 4 and max(hot) <= 3 * sorted(hot)[len(hot) // 2]


def test_ranking_pairs_meet_only_their_negatives(spark):
    from maskloom.operators import judging

    rows = [(f"p{i}", "preserved", 1) for i in range(50)] + [(f"n{i}", "changed", 1) for i in range(300)] + [("q", "preserved", 2), ("r", "changed", 2), ("s", "preserved", 3)]
    df = spark.createDataFrame(rows, "pair_id string, label string, g int")
    got = judging.ranking_pairs(df, "g").collect()
    per = collections.Counter(r["positive"] for r in got)
    assert per == {**{f"p{i}": 4 for i in range(50)}, "q": 1} and len({r["ranking_id"] for r in got}) == len(got)
    assert len({r["negative"] for r in got if r["g"] == 1}) > 100
    assert sorted(map(tuple, got)) == sorted(map(tuple, judging.ranking_pairs(df.repartition(7), "g").collect()))
