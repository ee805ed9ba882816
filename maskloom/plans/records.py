"""Record-level queries: labels, normalized rows, upserts, marked texts."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as T
from ..operators import inventory as inv
from ..operators import judging as J
from ..operators.skew import spread_join
from ..sources.tables import table


def _contexts(spark, folder):
    m = table(spark, folder, "mentions").groupBy("id").agg(F.min("entity_id").alias("entity_id"), F.min("full_context").alias("context"))
    return spread_join(m, table(spark, folder, "entities").select(F.col("id").alias("entity_id"), "surface"), "entity_id")


def p01_labels(spark, folder):
    v = J.votes(table(spark, folder, "judgments"))
    number = F.when(F.col("label") == "preserved", 1).when(F.col("label") == "changed", 0).cast("long")
    return v.select("judgment_id", number.alias("label"))


def p03_normalized(spark, folder):
    """The canonical row: both sides, label, names, ids, types and sources, blanks as null; rows that lack a side, a name or a label are left out."""
    v = J.votes(table(spark, folder, "judgments")).where("label IN ('preserved', 'changed')")
    m = table(spark, folder, "mentions").groupBy(F.col("id").alias("mention_id")).agg(F.min("full_context").alias("context"), F.min("text_id").alias("text_id"), F.min("observed_type").alias("observed_type"))
    e = table(spark, folder, "entities").select(F.col("id").alias("entity_id"), "heuristic_type", "heuristic_group")
    t = table(spark, folder, "texts").select(F.col("id").alias("text_id"), "dataset_id", "source_id")
    d = table(spark, folder, "datasets").select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset"), "domain")
    rows = v.join(m, "mention_id").join(e, "entity_id", "left").join(t, "text_id", "left").join(F.broadcast(d), "dataset_id", "left")  # datasets: a fixed small table
    entity, candidate = (F.nullif(T.normalize_space(F.col(c)), F.lit("")) for c in ("entity", "candidate"))
    right = T.replace_first(F.col("context"), F.col("entity"), F.col("candidate"))
    out = rows.select(
        "judgment_id", "pair_id", F.md5("context").alias("left_md5"), F.md5(right).alias("right_md5"), F.when(F.col("label") == "preserved", 1).otherwise(0).cast("long").alias("label"),
        entity.alias("entity"), candidate.alias("candidate"), "entity_id", F.coalesce("heuristic_type", "observed_type", F.lit("UNKNOWN")).alias("entity_type"),
        F.coalesce("heuristic_group", F.lit("ambiguous")).alias("coarse_group"), F.lit("judged").alias("pair_kind"), F.coalesce("judge_provider", F.lit("none")).alias("branch"),
        F.nullif(F.trim("source_id"), F.lit("")).alias("source_id"), "text_id", "mention_id", "dataset", "domain", F.lit("judgments").alias("corpus_source"),
    )
    return out.where("entity IS NOT NULL AND candidate IS NOT NULL AND left_md5 IS NOT NULL")


def t22_marked(spark, folder):
    return _contexts(spark, folder).select("id", F.md5(T.mark_first(F.col("context"), F.col("surface"))).alias("md5"))


def t11_replaced(spark, folder):
    return _contexts(spark, folder).select("id", F.md5(T.replace_first(F.col("context"), F.col("surface"), F.lit("X"))).alias("md5"))


def t10_nth_literal(spark, folder):
    t = table(spark, folder, "texts").where("original_text IS NOT NULL")
    return t.select("id", F.md5(T.replace_nth(F.col("original_text"), F.lit(" the "), F.lit(1), F.lit(" THE "))).alias("md5"))


def t21_differing_spans(spark, folder):
    v = table(spark, folder, "judgments").select("pair_id", "entity", "candidate").distinct().where("entity IS NOT NULL AND candidate IS NOT NULL")
    return v.select("pair_id", "entity", "candidate", T.differing_span(F.col("entity"), F.col("candidate")).alias("d")).select("pair_id", "entity", "candidate", "d.left", "d.right")


def k05_upsert(spark, folder):
    e = table(spark, folder, "entities").select("id", "surface", "mention_count")
    new = e.where("id % 5 = 0").select("id", F.upper("surface").alias("surface"), (F.col("mention_count") + 1).alias("mention_count"))
    return inv.merged(e, new, ["id"])


def k07_insert_or_ignore(spark, folder):
    e = table(spark, folder, "entities").select(F.lower("surface").alias("key"), "surface", "id")
    return inv.inserted_or_ignored(inv.first_per_key(e.where("id % 2 = 0"), ["key"], F.col("id")), e.where("id % 2 = 1"), ["key"], F.col("id"))


def l01_sorted_head(spark, folder):
    c = table(spark, folder, "mentions").groupBy("entity_id").agg(F.count("*").alias("n"))
    return c.join(table(spark, folder, "entities").select(F.col("id").alias("entity_id"), "surface"), "entity_id").orderBy(F.desc("n"), F.lower("surface"), "entity_id").limit(100)


def l06_first_matching(spark, folder):
    v = J.votes(table(spark, folder, "judgments")).select("judgment_id", "pair_id", "label")
    directed = table(spark, folder, "directional_judgments").select("pair_id").distinct().withColumn("d", F.lit(0))
    rows = v.join(directed, "pair_id", "left").withColumn("priority", F.coalesce("d", F.when(F.col("label").isin("preserved", "changed"), 1), F.lit(2)).cast("long"))
    top = rows.orderBy("priority", "judgment_id").limit(60)
    place = F.row_number().over(Window.orderBy("priority", "judgment_id"))
    return top.select(place.cast("long").alias("place"), "judgment_id", "label", "priority")


def a04_corpus_summary(spark, folder):
    j = table(spark, folder, "judgments")
    return j.agg(F.count_distinct("judgment_id").alias("rows"), F.count_distinct("pair_id").alias("pairs"), F.count_distinct("entity_id").alias("entities"), F.count_distinct(F.lower("candidate")).alias("candidates"), F.count_distinct("mention_id").alias("mentions"))


def a25_reasons(spark, folder):
    t = table(spark, folder, "texts")
    reason = F.when(F.col("original_text").isNull() & F.col("summary").isNull(), "no_text").when(F.col("original_text").isNull(), "summary_only").when(F.col("summary").isNull(), "no_summary").otherwise("complete")
    return t.groupBy("dataset_id", reason.alias("reason")).agg(F.count("*").alias("n"))


def p18_overrides(spark, folder):
    """Labels set by hand for an entity and a candidate, with the reason; of several the alphabetically first reason."""
    v = J.votes(table(spark, folder, "judgments")).select("judgment_id", "entity_id", F.lower("candidate").alias("c"), "label", "rationale")
    manual = table(spark, folder, "good_candidates").where("candidate IS NOT NULL").groupBy("entity_id", F.lower("candidate").alias("c"))
    manual = manual.agg(F.lit("preserved").alias("manual"), F.min("rationale").alias("reason"))
    out = v.join(manual, ["entity_id", "c"], "left")
    set_ = F.col("manual").isNotNull()
    return out.select("judgment_id", F.coalesce("manual", "label").alias("label"), F.when(set_, F.col("reason")).otherwise(F.col("rationale")).alias("rationale"), set_.alias("overridden"))


def p13_prompts(spark, folder):
    g = table(spark, folder, "good_candidates").select("candidate_id", "candidate", "relation").distinct()
    return g.select("candidate_id", F.to_json(F.struct(F.col("candidate_id").alias("id"), "candidate", "relation")).alias("prompt"))


def a06_vote_shares(spark, folder):
    v = J.votes(table(spark, folder, "judgments")).where("label <> 'missing'")
    return v.groupBy("annotator_id").pivot("label", ["preserved", "changed", "uncertain"]).agg(F.count(F.lit(1))).na.fill(0)


def w01_best_candidate(spark, folder):
    g = table(spark, folder, "good_candidates").where("confidence IS NOT NULL AND NOT isnan(confidence)").select("entity_id", "candidate_id", "candidate", "confidence")
    return inv.first_per_key(g, ["entity_id"], F.desc("confidence"), F.col("candidate_id")).select("entity_id", "candidate_id", "candidate")


def p05_sources(spark, folder):
    a = table(spark, folder, "good_candidates").select("candidate").distinct().withColumn("corpus_source", F.lit("good"))
    b = table(spark, folder, "judgments").select("candidate").distinct().withColumn("corpus_source", F.lit("judged"))
    return a.unionByName(b).groupBy("corpus_source").agg(F.count("*").alias("n"), F.count_if(R.surface_group(F.col("candidate")) == "upper").alias("n_upper"))


QUERIES = {k: f for k, f in globals().items() if callable(f) and k[0] in "ptklaw" and k[1:3].isdigit()}

from .judging import _V  # noqa: E402

_X = "x AS (SELECT m.id, m.entity_id, context, surface FROM (SELECT id, min(entity_id) AS entity_id, min(full_context) AS context FROM mentions GROUP BY id) m JOIN entities e ON e.id = m.entity_id)"


def _around(text, needle, middle):
    at = f"strpos(lower({text}), lower({needle}))"
    return f"CASE WHEN {at} > 0 AND length({needle}) > 0 THEN substring({text}, 1, {at} - 1) || {middle.format(found=f'substring({text}, {at}, length({needle}))')} || substring({text}, {at} + length({needle})) ELSE {text} END"


_SPACED = r"trim(regexp_replace({x}, '[\s\x{{00A0}}]+', ' ', 'g'), ' ')"

_SPACED = r"trim(regexp_replace({x}, '[\s\x{{00A0}}]+', ' ', 'g'))"

SQL = {
    "p01_labels": f"WITH {_V} SELECT judgment_id, CAST(CASE label WHEN 'preserved' THEN 1 WHEN 'changed' THEN 0 END AS BIGINT) AS label FROM v",
    "p03_normalized": f"""WITH {_V}, m AS (SELECT id AS mention_id, min(full_context) AS context, min(text_id) AS text_id, min(observed_type) AS observed_type FROM mentions GROUP BY id),
        r AS (SELECT v.*, context, m.text_id, observed_type, heuristic_type, heuristic_group, source_id, d.name AS dataset, domain FROM v JOIN m USING (mention_id) LEFT JOIN entities e ON e.id = v.entity_id LEFT JOIN texts t ON t.id = m.text_id LEFT JOIN datasets d ON d.id = t.dataset_id WHERE label IN ('preserved', 'changed'))
        SELECT judgment_id, pair_id, md5(context) AS left_md5, md5(CASE WHEN strpos(lower(context), lower(entity)) > 0 AND length(entity) > 0 THEN substring(context, 1, strpos(lower(context), lower(entity)) - 1) || candidate || substring(context, strpos(lower(context), lower(entity)) + length(entity)) ELSE context END) AS right_md5,
          CASE WHEN label = 'preserved' THEN 1 ELSE 0 END::BIGINT AS label, nullif({_SPACED.format(x='entity')}, '') AS entity, nullif({_SPACED.format(x='candidate')}, '') AS candidate, entity_id, coalesce(heuristic_type, observed_type, 'UNKNOWN') AS entity_type, coalesce(heuristic_group, 'ambiguous') AS coarse_group,
          'judged' AS pair_kind, coalesce(judge_provider, 'none') AS branch, nullif(trim(source_id, ' '), '') AS source_id, text_id, mention_id, dataset, domain, 'judgments' AS corpus_source FROM r
        WHERE nullif({_SPACED.format(x='entity')}, '') IS NOT NULL AND nullif({_SPACED.format(x='candidate')}, '') IS NOT NULL AND context IS NOT NULL""",
    "t22_marked": f"WITH {_X} SELECT id, md5({_around('context', 'surface', chr(39) + '[' + chr(39) + ' || {found} || ' + chr(39) + ']' + chr(39))}) AS md5 FROM x",
    "t11_replaced": f"WITH {_X} SELECT id, md5({_around('context', 'surface', chr(39) + 'X' + chr(39))}) AS md5 FROM x",
    "t10_nth_literal": """WITH p AS (SELECT id, string_split(original_text, ' the ') AS p FROM texts WHERE original_text IS NOT NULL)
        SELECT id, CASE WHEN len(p) > 2 THEN md5(p[1] || ' the ' || p[2] || ' THE ' || array_to_string(p[3:], ' the ')) END AS md5 FROM p""",
    "t21_differing_spans": """WITH r AS (SELECT DISTINCT pair_id, entity AS a, candidate AS b FROM judgments WHERE entity IS NOT NULL AND candidate IS NOT NULL),
        p AS (SELECT *, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda k: substring(a, 1, k) = substring(b, 1, k))) AS p FROM r),
        s AS (SELECT *, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda k: k <= least(length(a), length(b)) - p AND substring(reverse(a), 1, k) = substring(reverse(b), 1, k))) AS s FROM p)
        SELECT pair_id, a AS entity, b AS candidate, substring(a, p + 1, length(a) - p - s) AS "left", substring(b, p + 1, length(b) - p - s) AS "right" FROM s""",
    "k05_upsert": "SELECT id, CASE WHEN id % 5 = 0 THEN upper(surface) ELSE surface END AS surface, CASE WHEN id % 5 = 0 THEN mention_count + 1 ELSE mention_count END AS mention_count FROM entities",
    "k07_insert_or_ignore": """SELECT key, surface, id FROM (SELECT lower(surface) AS key, surface, id, row_number() OVER (PARTITION BY lower(surface) ORDER BY id % 2, id) AS r FROM entities) WHERE r = 1""",
    "l01_sorted_head": """SELECT entity_id, n, surface FROM (SELECT entity_id, count(*) AS n FROM mentions GROUP BY ALL) JOIN entities e ON e.id = entity_id ORDER BY n DESC, lower(surface) NULLS FIRST, entity_id LIMIT 100""",
    "l06_first_matching": f"""WITH {_V}, q AS (SELECT judgment_id, label, CAST(CASE WHEN pair_id IN (SELECT pair_id FROM directional_judgments) THEN 0 WHEN label IN ('preserved', 'changed') THEN 1 ELSE 2 END AS BIGINT) AS priority FROM v)
        SELECT row_number() OVER (ORDER BY priority, judgment_id) AS place, judgment_id, label, priority FROM q ORDER BY priority, judgment_id LIMIT 60""",
    "a04_corpus_summary": "SELECT count(DISTINCT judgment_id) AS rows, count(DISTINCT pair_id) AS pairs, count(DISTINCT entity_id) AS entities, count(DISTINCT lower(candidate)) AS candidates, count(DISTINCT mention_id) AS mentions FROM judgments",
    "a25_reasons": """SELECT dataset_id, CASE WHEN original_text IS NULL AND summary IS NULL THEN 'no_text' WHEN original_text IS NULL THEN 'summary_only' WHEN summary IS NULL THEN 'no_summary' ELSE 'complete' END AS reason, count(*) AS n FROM texts GROUP BY ALL""",
    "p18_overrides": f"""WITH {_V}, g AS (SELECT entity_id, lower(candidate) AS c, min(rationale) AS reason FROM good_candidates WHERE candidate IS NOT NULL GROUP BY ALL)
        SELECT judgment_id, CASE WHEN g.c IS NOT NULL THEN 'preserved' ELSE label END AS label, CASE WHEN g.c IS NOT NULL THEN reason ELSE rationale END AS rationale, g.c IS NOT NULL AS overridden FROM v LEFT JOIN g ON g.entity_id = v.entity_id AND g.c = lower(v.candidate)""",
    "p13_prompts": """SELECT candidate_id, '{"id":' || candidate_id || ',"candidate":' || to_json(candidate) || ',"relation":' || to_json(relation) || '}' AS prompt FROM (SELECT DISTINCT candidate_id, candidate, relation FROM good_candidates)""",
    "a06_vote_shares": f"WITH {_V} SELECT annotator_id, count(*) FILTER (label = 'preserved') AS preserved, count(*) FILTER (label = 'changed') AS changed, count(*) FILTER (label = 'uncertain') AS uncertain FROM v WHERE label <> 'missing' GROUP BY annotator_id",
    "w01_best_candidate": """SELECT entity_id, candidate_id, candidate FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, candidate_id) AS r FROM good_candidates WHERE confidence IS NOT NULL AND NOT isnan(confidence)) WHERE r = 1""",
    "p05_sources": """WITH a AS (SELECT DISTINCT candidate, 'good' AS corpus_source FROM good_candidates UNION ALL SELECT DISTINCT candidate, 'judged' FROM judgments)
        SELECT corpus_source, count(*) AS n, count(*) FILTER (NOT regexp_matches(candidate, '\\d') AND regexp_matches(candidate, '\\p{L}') AND upper(candidate) = candidate AND length(candidate) > 1) AS n_upper FROM a GROUP BY ALL""",
}
