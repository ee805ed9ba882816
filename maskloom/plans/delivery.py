"""Queries of what is handed on: parts, warnings, windows, parsed answers, ids of tags."""

from pyspark.sql import functions as F

from ..operators import judging as J
from ..operators import scoring as S
from ..sources import files
from ..sources.tables import table


def k17_round_robin(spark, folder):
    rows = table(spark, folder, "judgments").select("pair_id").distinct()
    return files.split_round_robin(rows, "pair_id", 3).select("pair_id", F.col("part").cast("long").alias("part"))


def k18_warnings(spark, folder):
    """Pairs asked for, against the rows that came back for them from the directional table."""
    j = table(spark, folder, "judgments").groupBy("pair_id").agg(F.min("annotator_id").alias("who"))
    d = table(spark, folder, "directional_judgments").distinct().select("pair_id", F.col("annotator_id").alias("who"))
    return S.alignment_warnings(j, d, "pair_id", "who")


def k19_windows(spark, folder):
    """Judged against proposed pairs, in windows of a hundred entities."""
    window = F.floor(F.col("entity_id") / 100).cast("long").alias("window")
    made = table(spark, folder, "judgments").select("pair_id", "entity_id").distinct().select(window)
    had = table(spark, folder, "directional_judgments").select("pair_id").distinct().join(table(spark, folder, "judgments").select("pair_id", "entity_id").distinct(), "pair_id").select(window)
    return S.complete_windows(made, had, "window")


def s15_tagged_ids(spark, folder):
    e = table(spark, folder, "entities").select(F.col("id").cast("string").alias("entity_id"), F.col("heuristic_group").alias("coarse_group"), F.col("id").alias("place"))
    return files.entity_ids(e, "proper_name", 200)


def s17_parsed(spark, folder):
    """Answers in both shapes, written from the judgments and read again."""
    v = J.votes(table(spark, folder, "judgments")).where("label <> 'missing'").groupBy("pair_id").agg(F.min("label").alias("label"), F.min("score").alias("score"))
    full = F.concat(F.lit("```json\nHere: "), F.to_json(F.struct(F.array(F.struct("pair_id", F.upper("label").alias("label"), F.nanvl("score", F.lit(None).cast("double")).alias("score"))).alias("results"))), F.lit("\n```"))
    short = F.to_json(F.create_map("pair_id", "label"))
    even = F.pmod(F.regexp_extract("pair_id", "([0-9]+)$", 1).cast("long"), F.lit(2)) == 0
    rows = v.select(F.col("pair_id").alias("batch"), F.when(even, full).otherwise(short).alias("content"))
    return files.parsed_judgments(rows, "batch", "content").select("pair_id", "label", F.round("score", 6).alias("score"))


def k13_split_counts(spark, folder):
    """Rows and entities of each split as they would be written, review rows at most twenty."""
    from .quality import c04_grouped_split

    j = J.votes(table(spark, folder, "judgments")).select("judgment_id", "entity_id", "label")
    rows = j.join(c04_grouped_split(spark, folder), "entity_id").withColumn("split", F.when(F.col("label").isin("preserved", "changed"), F.col("split")).otherwise("review"))
    per = rows.groupBy("split").agg(F.count("*").alias("n"))
    return per.select("split", F.when(F.col("split") == "review", F.least("n", F.lit(20))).otherwise(F.col("n")).cast("long").alias("n"))


QUERIES = {k: f for k, f in globals().items() if callable(f) and k[0] in "ks" and k[1:3].isdigit()}

from .judging import _V  # noqa: E402
from .quality import _hash_split  # noqa: E402

SQL = {
    "k17_round_robin": "SELECT pair_id, (row_number() OVER (ORDER BY sha1('41|' || pair_id), pair_id) - 1) % 3 AS part FROM (SELECT DISTINCT pair_id FROM judgments WHERE pair_id IS NOT NULL)",
    "k18_warnings": """WITH j AS (SELECT pair_id, min(annotator_id) AS a FROM judgments GROUP BY pair_id), d AS (SELECT pair_id, count(*) AS n, min(annotator_id) AS b FROM (SELECT DISTINCT * FROM directional_judgments) GROUP BY pair_id),
        f AS (SELECT coalesce(j.pair_id, d.pair_id) AS pair_id, j.pair_id IS NOT NULL AS asked, a, b, n FROM j FULL JOIN d ON j.pair_id = d.pair_id)
        SELECT pair_id, 'missing_answer' AS warning FROM f WHERE n IS NULL UNION ALL SELECT pair_id, 'duplicate_answer' FROM f WHERE n > 1 UNION ALL SELECT pair_id, 'unknown_id' FROM f WHERE NOT asked
        UNION ALL SELECT pair_id, 'surface_repaired' FROM f WHERE asked AND n IS NOT NULL AND a IS DISTINCT FROM b""",
    "k19_windows": """WITH p AS (SELECT DISTINCT pair_id, entity_id FROM judgments), g AS (SELECT CAST(floor(entity_id / 100) AS BIGINT) AS w, count(*) AS n FROM p GROUP BY 1),
        h AS (SELECT CAST(floor(entity_id / 100) AS BIGINT) AS w, count(*) AS n FROM (SELECT DISTINCT pair_id FROM directional_judgments) JOIN p USING (pair_id) GROUP BY 1)
        SELECT g.w AS "window", g.n AS n_generated, coalesce(h.n, 0) AS n_judged, CASE WHEN coalesce(h.n, 0) >= g.n THEN 'done' WHEN coalesce(h.n, 0) > 0 THEN 'resume' ELSE 'start' END AS state FROM g LEFT JOIN h ON g.w = h.w""",
    "s15_tagged_ids": "SELECT CAST(id AS VARCHAR) AS entity_id FROM entities WHERE heuristic_group = 'proper_name' ORDER BY id LIMIT 200",
    "s17_parsed": f"""WITH {_V}, g AS (SELECT pair_id, min(label) AS label, min(score) AS score FROM v WHERE label <> 'missing' GROUP BY pair_id), k AS (SELECT *, CAST(regexp_extract(pair_id, '([0-9]+)$', 1) AS BIGINT) % 2 = 0 AS whole FROM g)
        SELECT pair_id, label, round(coalesce(CASE WHEN whole AND NOT isnan(score) THEN score END, CASE label WHEN 'changed' THEN 0.0 WHEN 'uncertain' THEN 0.5 ELSE 1.0 END), 6) AS score FROM k""",
    "k13_split_counts": f"""WITH {_V}, {_hash_split('entity_id')}, r AS (SELECT CASE WHEN label IN ('preserved', 'changed') THEN split ELSE 'review' END AS split FROM v JOIN x USING (entity_id))
        SELECT split, CASE WHEN split = 'review' THEN least(count(*), 20) ELSE count(*) END AS n FROM r GROUP BY split""",
}
