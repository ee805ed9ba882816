"""Judging queries."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import judging as J
from ..sources.tables import table


def _votes(spark, folder):
    return J.votes(table(spark, folder, "judgments"))


def _directed(spark, folder):
    return J.directed(table(spark, folder, "directional_judgments"))


def a12_consensus(spark, folder):
    return J.consensus(_votes(spark, folder))


def j16_votes(spark, folder):
    both = _votes(spark, folder).select("pair_id", "label").unionByName(_directed(spark, folder).select("pair_id", "label"))
    return both.groupBy("pair_id", "label").agg(F.count("*").alias("n"))


def j04_repair(spark, folder):
    fixes = _directed(spark, folder).groupBy("pair_id").agg(F.min("label").alias("label"))
    out = J.repaired(_votes(spark, folder).select("judgment_id", "pair_id", "label"), fixes, "pair_id")
    return out.groupBy("label").agg(F.count("*").alias("n"))


def j09_resume_anti(spark, folder):
    pairs = table(spark, folder, "judgments").select("pair_id").distinct()
    return J.unanswered(pairs, table(spark, folder, "directional_judgments"), "pair_id")


def j17_missing(spark, folder):
    pairs = table(spark, folder, "judgments").select("pair_id").distinct()
    found = _directed(spark, folder).groupBy("pair_id").agg(F.min("label").alias("label"))
    return pairs.join(found, "pair_id", "left").select("pair_id", F.coalesce("label", F.lit("missing")).alias("label"))


def a05_expected_agreement(spark, folder):
    kind = F.when(F.lower(F.trim("entity")) == F.lower(F.trim("candidate")), "identity").otherwise("other")
    rows = _votes(spark, folder).where("label <> 'missing'").select(kind.alias("kind"), "label")
    ok = F.when(F.col("kind") == "identity", F.col("label") == "preserved").otherwise(F.col("label") == "changed")
    return rows.groupBy("kind").agg(F.count_if(ok).alias("ok"), F.count("*").alias("total")).withColumn("rate", F.round(F.col("ok") / F.col("total"), 3))


def p07_bands(spark, folder):
    rows = _votes(spark, folder).where("score IS NOT NULL AND NOT isnan(score)").select(R.band(F.col("score")).alias("band"), "label")
    return rows.groupBy("band", "label").agg(F.count("*").alias("n"))


def p08_reject_band(spark, folder):
    rows = _votes(spark, folder).where("score IS NOT NULL AND NOT isnan(score)")
    return rows.groupBy(R.band(F.col("score"), 0.4, 0.6).alias("band")).agg(F.count("*").alias("n"))


def f15_mismatches(spark, folder):
    rows = _votes(spark, folder).where("score IS NOT NULL AND NOT isnan(score) AND label <> 'missing'")
    return rows.select("judgment_id", "pair_id", "label", R.band(F.col("score"), 0.4, 0.6).alias("band")).where("label <> band")


def a13_kappa(spark, folder):
    own = _votes(spark, folder).select("pair_id", "annotator_id", F.col("label").alias("a"), F.coalesce("judge_provider", F.lit("none")).alias("provider"))
    second = _directed(spark, folder).groupBy("pair_id", "annotator_id").agg(F.min("label").alias("b"))
    both = own.where("a <> 'missing'").join(second.where("b <> 'missing'"), ["pair_id", "annotator_id"])
    rows = both.select("a", "b", F.explode(F.array(F.lit("all"), F.concat(F.lit("provider:"), "provider"), F.concat(F.lit("label:"), "a"))).alias("bucket"))
    return J.agreement(rows, "bucket", "a", "b")


def a19_confidence_bins(spark, folder):
    c = F.col("confidence")
    rows = _directed(spark, folder).select("annotator_id", F.when(F.isnan(c) | c.isNull(), "none").when(c <= 0, "0").when(c < 0.5, "<0.5").when(c < 0.8, "0.5-0.8").otherwise(">=0.8").alias("bin"))
    sets = rows.groupingSets([["bin"], ["annotator_id", "bin"]], "annotator_id", "bin").agg(F.count("*").alias("n"), F.grouping("annotator_id").alias("g"))
    return sets.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("annotator_id")).alias("annotator_id"), "bin", "n")


def j05_overlay(spark, folder):
    return J.overlay(_directed(spark, folder), ["a_to_b", "b_to_a"], "pair_id")


def p10_relation(spark, folder):
    return _directed(spark, folder).groupBy("a_to_b", "b_to_a", "derived").agg(F.count("*").alias("n"))


def p11_consistency(spark, folder):
    d = _directed(spark, folder)
    ok = F.col("relation").eqNullSafe(F.col("derived"))
    return d.groupBy("annotator_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_consistent"))


def p12_nli_unpivot(spark, folder):
    named = _votes(spark, folder).groupBy("pair_id").agg(F.min("entity").alias("entity"), F.min("candidate").alias("candidate"))
    return J.nli_examples(_directed(spark, folder).where("confidence IS NOT NULL AND NOT isnan(confidence)").join(named, "pair_id"))


def a17_confusion(spark, folder):
    d = _directed(spark, folder)
    return d.groupBy(F.col("derived").alias("truth"), F.coalesce("relation", F.lit("missing")).alias("pred")).agg(F.count("*").alias("n"))


def a18_class_report(spark, folder):
    d = _directed(spark, folder).select(F.col("derived").alias("t"), F.coalesce("relation", F.lit("missing")).alias("p"))
    one = d.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.lit(1).alias("support"), F.lit(0).alias("predicted"), (F.col("t") == F.col("p")).cast("int").alias("hit")), F.struct(F.col("p").alias("c"), F.lit(0).alias("support"), F.lit(1).alias("predicted"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    g = one.groupBy("c").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    p, r = F.col("hit") / F.greatest("predicted", F.lit(1)), F.col("hit") / F.greatest("support", F.lit(1))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return g.select(F.col("c").alias("class"), "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def j18_ranking(spark, folder):
    rows = J.consensus(_votes(spark, folder), 1, 1).select("pair_id", "label")
    entity = table(spark, folder, "judgments").groupBy("pair_id").agg(F.min("entity_id").alias("entity_id"))
    return J.ranking_pairs(rows.join(entity, "pair_id"), "entity_id")


def a26_ranking_groups(spark, folder):
    return j18_ranking(spark, folder).groupBy("entity_id").agg(F.count("*").alias("n_pairs"), F.count_distinct("positive").alias("n_positive"))


def w10_stratified(spark, folder):
    rows = _votes(spark, folder).withColumn("judge_provider", F.coalesce("judge_provider", F.lit("none")))
    return J.stratified_sample(rows.select("judgment_id", "judge_provider", "label"), ["judge_provider", "label"], "judgment_id", 240)


def p17_stripped(spark, folder):
    j = table(spark, folder, "judgments")
    return j.drop(*[c for c in j.columns if c.startswith("judge")]).select("pair_id", "entity", "candidate").distinct()


def a20_kpis(spark, folder):
    rows = _votes(spark, folder).where("score IS NOT NULL AND NOT isnan(score)")
    mismatch = (F.col("label") != "missing") & (F.col("label") != R.band(F.col("score"), 0.4, 0.6))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_if(mismatch).alias("n_mismatch"))


def f10_viewer(spark, folder):
    rows = _votes(spark, folder)
    text = F.lower(F.concat_ws(" ", "entity", "candidate", "rationale", "pair_id"))
    shown = rows.where((F.col("label") == "changed") & (F.lower("entity") != F.lower("candidate")) & text.contains("other"))
    return shown.select("judgment_id", "pair_id", "entity", "candidate", "label")


QUERIES = {k: f for k, f in globals().items() if callable(f) and not k.startswith("_") and k[0] in "ajpfw" and k[1:3].isdigit()}

_V = """v AS (SELECT DISTINCT judgment_id, pair_id, mention_id, entity_id, entity, candidate, annotator_id, judge_provider, score, rationale,
  CASE WHEN starts_with(w, 'preserv') THEN 'preserved' WHEN starts_with(w, 'change') THEN 'changed' WHEN starts_with(w, 'uncertain') OR starts_with(w, 'unsure') THEN 'uncertain' ELSE 'missing' END AS label
  FROM (SELECT *, regexp_replace(lower(label), '[^a-z]', '', 'g') AS w FROM judgments))"""
_D = """d AS (SELECT DISTINCT judgment_id, pair_id, annotator_id, a_to_b, b_to_a, relation, confidence,
  CASE WHEN starts_with(w, 'preserv') THEN 'preserved' WHEN starts_with(w, 'change') THEN 'changed' WHEN starts_with(w, 'uncertain') OR starts_with(w, 'unsure') THEN 'uncertain' ELSE 'missing' END AS label,
  CASE WHEN a_to_b = 'uncertain' OR b_to_a = 'uncertain' OR a_to_b IS NULL OR b_to_a IS NULL THEN 'uncertain' WHEN a_to_b = 'contradiction' OR b_to_a = 'contradiction' THEN 'contradiction'
    WHEN a_to_b = 'entailment' AND b_to_a = 'entailment' THEN 'equivalence' WHEN a_to_b = 'entailment' THEN 'generalization' WHEN b_to_a = 'entailment' THEN 'specialization' ELSE 'substitution' END AS derived
  FROM (SELECT *, regexp_replace(lower(preserves_meaning), '[^a-z]', '', 'g') AS w FROM directional_judgments))"""
_B = "CASE WHEN score >= {h} THEN 'preserved' WHEN score <= {l} THEN 'changed' ELSE 'uncertain' END"
_B10, _B60 = _B.format(h=0.9, l=0.1), _B.format(h=0.6, l=0.4)
_C = """c AS (SELECT pair_id, count(*) FILTER (label = 'preserved') AS p, count(*) FILTER (label = 'changed') AS n FROM v GROUP BY pair_id)"""


def ranking_sql(group):
    return f"""WITH {_V}, {_C}, l AS (SELECT pair_id, CASE WHEN p >= 1 AND n = 0 THEN 'preserved' WHEN n >= 1 AND p = 0 THEN 'changed' END AS label FROM c),
      e AS (SELECT pair_id, min({group}) AS g FROM judgments WHERE {group} IS NOT NULL GROUP BY ALL), x AS (SELECT * FROM l JOIN e USING (pair_id)),
      n AS (SELECT g, pair_id AS negative, row_number() OVER (PARTITION BY g ORDER BY sha1('17|' || pair_id), pair_id) - 1 AS k, count(*) OVER (PARTITION BY g) AS size FROM x WHERE label = 'changed'),
      r AS (SELECT p.g AS {group}, p.pair_id AS positive, negative FROM x p JOIN n ON n.g = p.g AND p.label = 'preserved' WHERE (k - CAST(('0x' || substring(sha1('17|' || p.pair_id), 1, 8)) AS BIGINT) % size + size) % size < 4)"""


_RANK = ranking_sql("entity_id")

SQL = {
    "a12_consensus": f"""WITH {_V}
        SELECT pair_id, count(*) FILTER (label = 'preserved') AS votes_p, count(*) FILTER (label = 'changed') AS votes_c,
          CASE WHEN count(*) FILTER (label = 'preserved') >= 2 AND count(*) FILTER (label = 'changed') = 0 THEN 'preserved' WHEN count(*) FILTER (label = 'changed') >= 2 AND count(*) FILTER (label = 'preserved') = 0 THEN 'changed' ELSE 'uncertain' END AS label,
          round(avg(score) FILTER (NOT isnan(score)) + 1e-9, 4) AS score, string_agg(concat_ws('=', annotator_id, label), '; ' ORDER BY judgment_id) AS rationale FROM v GROUP BY pair_id""",
    "j16_votes": f"""WITH {_V}, {_D} SELECT pair_id, label, count(*) AS n FROM (SELECT pair_id, label FROM v UNION ALL SELECT pair_id, label FROM d) GROUP BY ALL""",
    "j04_repair": f"""WITH {_V}, {_D}, f AS (SELECT pair_id, min(label) AS f FROM d GROUP BY ALL)
        SELECT CASE WHEN label = 'missing' AND f <> 'missing' THEN f ELSE label END AS label, count(*) AS n FROM v LEFT JOIN f USING (pair_id) GROUP BY ALL""",
    "j09_resume_anti": "SELECT DISTINCT pair_id FROM judgments WHERE pair_id NOT IN (SELECT pair_id FROM directional_judgments WHERE pair_id IS NOT NULL)",
    "j17_missing": f"""WITH {_D}, f AS (SELECT pair_id, min(label) AS label FROM d GROUP BY ALL)
        SELECT pair_id, coalesce(label, 'missing') AS label FROM (SELECT DISTINCT pair_id FROM judgments) LEFT JOIN f USING (pair_id)""",
    "a05_expected_agreement": f"""WITH {_V}, k AS (SELECT CASE WHEN lower(trim(entity)) = lower(trim(candidate)) THEN 'identity' ELSE 'other' END AS kind, label FROM v WHERE label <> 'missing'),
        g AS (SELECT kind, count(*) FILTER (label = CASE WHEN kind = 'identity' THEN 'preserved' ELSE 'changed' END) AS ok, count(*) AS total FROM k GROUP BY kind)
        SELECT kind, ok, total, round(CAST(ok AS DOUBLE) / total, 3) AS rate FROM g""",
    "p07_bands": f"WITH {_V} SELECT {_B10} AS band, label, count(*) AS n FROM v WHERE NOT isnan(score) GROUP BY ALL",
    "p08_reject_band": f"WITH {_V} SELECT {_B60} AS band, count(*) AS n FROM v WHERE NOT isnan(score) GROUP BY ALL",
    "f15_mismatches": f"WITH {_V} SELECT * FROM (SELECT judgment_id, pair_id, label, {_B60} AS band FROM v WHERE NOT isnan(score) AND label <> 'missing') WHERE label <> band",
    "a13_kappa": f"""WITH {_V}, {_D}, s AS (SELECT pair_id, annotator_id, min(label) AS b FROM d GROUP BY ALL),
        j AS (SELECT v.label AS a, b, coalesce(judge_provider, 'none') AS p FROM v JOIN s USING (pair_id, annotator_id) WHERE v.label <> 'missing' AND b <> 'missing'),
        r AS (SELECT a, b, unnest(['all', 'provider:' || p, 'label:' || a]) AS bucket FROM j),
        t AS (SELECT bucket, count(*) AS n, count(*) FILTER (a = b) AS same FROM r GROUP BY bucket),
        m AS (SELECT bucket, l, sum(x) AS p, sum(y) AS q FROM (SELECT bucket, a AS l, 1 AS x, 0 AS y FROM r UNION ALL SELECT bucket, b, 0, 1 FROM r) GROUP BY ALL),
        c AS (SELECT bucket, CAST(sum(p * q) AS DOUBLE) AS pq FROM m GROUP BY bucket)
        SELECT bucket, n, round(CAST(same AS DOUBLE) / n, 6) AS agreement, CASE WHEN pq / (n * n) < 1 THEN round((CAST(same AS DOUBLE) / n - pq / (n * n)) / (1 - pq / (n * n)), 6) END AS kappa FROM t JOIN c USING (bucket)""",
    "a19_confidence_bins": f"""WITH {_D}, b AS (SELECT annotator_id, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 'none' WHEN confidence <= 0 THEN '0' WHEN confidence < 0.5 THEN '<0.5' WHEN confidence < 0.8 THEN '0.5-0.8' ELSE '>=0.8' END AS bin FROM d)
        SELECT annotator_id, bin, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT 'ALL', bin, count(*) FROM b GROUP BY bin""",
    "j05_overlay": f"""WITH {_D} SELECT pair_id, min(a_to_b) AS a_to_b, min(b_to_a) AS b_to_a FROM d GROUP BY pair_id HAVING count(DISTINCT coalesce(a_to_b, '') || '|' || coalesce(b_to_a, '')) = 1""",
    "p10_relation": f"WITH {_D} SELECT a_to_b, b_to_a, derived, count(*) AS n FROM d GROUP BY ALL",
    "p11_consistency": f"WITH {_D} SELECT annotator_id, count(*) AS n, count(*) FILTER (relation = derived) AS n_consistent FROM d GROUP BY ALL",
    "p12_nli_unpivot": f"""WITH {_V}, {_D}, n AS (SELECT pair_id, min(entity) AS entity, min(candidate) AS candidate FROM v GROUP BY ALL),
        k AS (SELECT d.*, entity, candidate FROM d JOIN n USING (pair_id) WHERE NOT isnan(confidence) AND confidence >= 0.8 AND a_to_b IN ('entailment','neutral','contradiction') AND b_to_a IN ('entailment','neutral','contradiction'))
        SELECT pair_id, judgment_id, substring(sha1(pair_id || chr(31) || 'a_to_b'), 1, 20) AS nli_id, 'a_to_b' AS direction, entity AS premise, candidate AS hypothesis, a_to_b AS label FROM k
        UNION ALL SELECT pair_id, judgment_id, substring(sha1(pair_id || chr(31) || 'b_to_a'), 1, 20), 'b_to_a', candidate, entity, b_to_a FROM k""",
    "a17_confusion": f"WITH {_D} SELECT derived AS truth, coalesce(relation, 'missing') AS pred, count(*) AS n FROM d GROUP BY ALL",
    "a18_class_report": f"""WITH {_D}, x AS (SELECT derived AS t, coalesce(relation, 'missing') AS p FROM d), y AS (SELECT t AS c, 1 AS s, 0 AS q, CAST(t = p AS INT) AS h FROM x UNION ALL SELECT p, 0, 1, 0 FROM x),
        g AS (SELECT c, CAST(sum(s) AS BIGINT) AS support, CAST(sum(q) AS BIGINT) AS q, CAST(sum(h) AS BIGINT) AS h FROM y GROUP BY c), r AS (SELECT *, h / CAST(greatest(q, 1) AS DOUBLE) AS p, h / CAST(greatest(support, 1) AS DOUBLE) AS r FROM g)
        SELECT c AS class, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM r""",
    "j18_ranking": f"{_RANK} SELECT entity_id, substring(sha1(positive || chr(31) || negative), 1, 20) AS ranking_id, positive, negative FROM r",
    "a26_ranking_groups": f"{_RANK} SELECT entity_id, count(*) AS n_pairs, count(DISTINCT positive) AS n_positive FROM r GROUP BY entity_id",
    "w10_stratified": f"""WITH {_V}, s AS (SELECT judgment_id, coalesce(judge_provider, 'none') AS judge_provider, label FROM v),
        t AS (SELECT *, row_number() OVER (PARTITION BY judge_provider, label ORDER BY sha1('83|' || judgment_id)) AS turn FROM s),
        p AS (SELECT *, row_number() OVER (ORDER BY turn, judge_provider, label, judgment_id) AS place FROM t QUALIFY place <= 240)
        SELECT format('audit{{:06d}}', place) AS audit_id, judgment_id, judge_provider, label FROM p""",
    "p17_stripped": "SELECT DISTINCT pair_id, entity, candidate FROM judgments",
    "a20_kpis": f"""WITH {_V} SELECT label, count(*) AS n, round(avg(score), 6) AS mean_score, count(*) FILTER (label <> 'missing' AND label <> {_B60}) AS n_mismatch FROM v WHERE NOT isnan(score) GROUP BY label""",
    "f10_viewer": f"""WITH {_V} SELECT judgment_id, pair_id, entity, candidate, label FROM v
        WHERE label = 'changed' AND lower(entity) <> lower(candidate) AND contains(lower(concat_ws(' ', entity, candidate, rationale, pair_id)), 'other')""",
}
