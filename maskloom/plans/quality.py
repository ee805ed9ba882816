"""Cleaning, splitting, metric and vector queries."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cleaning as C
from ..operators import judging as J
from ..operators import metrics as M
from ..operators import splitting as S
from ..operators import vectors as V
from ..operators.skew import join_by_size
from ..durable import cut
from ..sources.tables import table


def _pairs(spark, folder):
    """One row per judged pair with the contexts of its mention and its consensus."""
    v = J.votes(table(spark, folder, "judgments"))
    base = v.groupBy("pair_id").agg(*[F.min(c).alias(c) for c in ("mention_id", "entity_id", "entity", "candidate", "judge_provider")])
    label = J.consensus(v, 1, 1).select("pair_id", F.col("label").alias("label"), "score")
    contexts = table(spark, folder, "mentions").groupBy(F.col("id").alias("mention_id")).agg(F.min("full_context").alias("context"), F.min("text_id").alias("text_id"))
    return base.join(label, "pair_id").join(contexts, "mention_id", "left")


def _predictions(spark, folder):
    """Scores of single judgments against the consensus of the pair where that is clear."""
    v = J.votes(table(spark, folder, "judgments"))
    truth = J.consensus(v, 1, 1).where("label <> 'uncertain'").select("pair_id", (F.col("label") == "preserved").alias("truth"))
    rows = v.where("score IS NOT NULL AND NOT isnan(score)").select("judgment_id", "pair_id", "entity_id", "annotator_id", F.coalesce("judge_provider", F.lit("none")).alias("judge_provider"), "score")
    return rows.join(truth, "pair_id")


def f01_reject_reasons(spark, folder):
    """Reasons of all pairs; the right side is the left one with the candidate in place of the entity."""
    e = table(spark, folder, "entities").select(F.col("id").alias("entity_id"), "heuristic_group")
    p = _pairs(spark, folder).join(e, "entity_id", "left")
    entity, candidate, left = (F.col(c) for c in ("entity", "candidate", "context"))
    reason = C.reject_reason(entity, candidate, left, T.replace_first(left, entity, candidate), F.col("label"), F.col("heuristic_group"))
    return p.groupBy(F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


def f03_flags(spark, folder):
    found = C.flags(F.col("entity"), F.col("candidate"), F.col("context"), T.replace_first(F.col("context"), F.col("entity"), F.col("candidate")))
    rows = _pairs(spark, folder).select(F.explode(found).alias("flag"), (F.size(C.critical(found)) > 0).alias("critical"))
    return rows.groupBy("flag", "critical").agg(F.count("*").alias("n"))


def f04_balance(spark, folder):
    v = J.votes(table(spark, folder, "judgments")).withColumn("judge_provider", F.coalesce("judge_provider", F.lit("none")))
    return C.balance(v, "judge_provider", "label", 5)


def f06_identity(spark, folder):
    return _pairs(spark, folder).where(C.same_identity(F.col("entity"), F.col("candidate"))).select("pair_id", "entity", "candidate")


def a09_dups(spark, folder):
    return C.duplicates(table(spark, folder, "judgments"), ["pair_id", "annotator_id"])


def a11_conflicts(spark, folder):
    v = J.votes(table(spark, folder, "judgments")).where("label IN ('preserved', 'changed')")
    rows = v.select(F.lower("entity").alias("entity"), F.lower("candidate").alias("candidate"), "label", "judgment_id")
    return C.resolved(rows, ["entity", "candidate"], "label", ["judgment_id"]).select("entity", "candidate", "status", "n_rows", F.col("judgment_id").alias("first_id"))


def u02_merge_distinct(spark, folder):
    g = table(spark, folder, "good_candidates").select("entity_id", F.lower("candidate").alias("candidate")).distinct()
    j = table(spark, folder, "judgments").select("entity_id", F.lower("candidate").alias("candidate")).distinct()
    out = C.union_distinct([g.withColumn("origin", F.lit("good")), j.withColumn("origin", F.lit("judged"))], ["entity_id", "candidate"])
    return out.select("entity_id", "candidate", "origin")


def u03_common_candidates(spark, folder):
    g = table(spark, folder, "good_candidates").select("entity_id", F.lower("candidate").alias("candidate"))
    return g.intersect(table(spark, folder, "judgments").select("entity_id", F.lower("candidate").alias("candidate")))


def u04_unjudged(spark, folder):
    g = table(spark, folder, "good_candidates").select("entity_id")
    return g.subtract(table(spark, folder, "judgments").select("entity_id"))


def f09_surface_relations(spark, folder):
    e = table(spark, folder, "entities").select(F.col("id").alias("entity_id"), "surface")
    g = table(spark, folder, "good_candidates").select("candidate_id", "entity_id", "candidate").distinct()
    return g.join(e, "entity_id").select("candidate_id", C.surface_relation(F.col("surface"), F.col("candidate")).alias("kind"))


def t28_overlap(spark, folder):
    e = table(spark, folder, "entities").select(F.col("id").alias("entity_id"), "surface")
    g = table(spark, folder, "good_candidates").select("candidate_id", "entity_id", "candidate").distinct()
    share = T.jaccard(F.array_distinct(T.tokens(F.col("surface"))), F.array_distinct(T.tokens(F.col("candidate"))))
    return g.join(e, "entity_id").select("candidate_id", F.round(share, 6).alias("jaccard"))


def j06_same_type_negative(spark, folder):
    return C.same_type_negatives(table(spark, folder, "mentions"), table(spark, folder, "entities"))


def a21_coverage(spark, folder):
    e = table(spark, folder, "entities").select(F.col("id").alias("entity_id"), "heuristic_group", "heuristic_type")
    stages = {"inventory": e.select("entity_id"), "mentioned": table(spark, folder, "mentions").select("entity_id"),
              "proposed": table(spark, folder, "good_candidates").select("entity_id"), "judged": table(spark, folder, "judgments").select("entity_id")}
    rows = None
    for name, ids in stages.items():
        one = e.join(ids.distinct(), "entity_id", "left_semi").withColumn("stage", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    out = rows.rollup("stage", "heuristic_group", "heuristic_type").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
    return out.where("level < 7").select("stage", "heuristic_group", "heuristic_type", F.col("level").cast("long").alias("level"), "n")


def c01_components(spark, folder):
    rows = _pairs(spark, folder).where("text_id IS NOT NULL").select("pair_id", "entity_id", "text_id")
    return S.component_sizes(S.entity_document_components(rows, "entity_id", "text_id"))


def _placed(spark, folder):
    """Pairs with their component, and whether their source (the provider) is rare: under 500 rows or 5 %, whichever is more."""
    rows = _pairs(spark, folder).where("text_id IS NOT NULL AND entity_id IS NOT NULL").select("pair_id", "entity_id", "text_id", F.coalesce("judge_provider", F.lit("none")).alias("source"))
    per = rows.groupBy("source").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    rare = per.join(F.broadcast(total)).where(F.col("n") < F.greatest(F.lit(500), F.floor(F.col("total") * 0.05))).select("source", F.lit(1).alias("rare"))
    flagged = join_by_size(rows, rare, "source", "left").withColumn("rare", F.coalesce("rare", F.lit(0)))
    return S.entity_document_components(flagged, "entity_id", "text_id")


_RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}


def c02_ratio_split(spark, folder):
    placed = _placed(spark, folder)
    split = S.greedy_splits(placed.groupBy("component").agg(F.count("*").alias("size")), _RATIOS)
    return placed.join(split, "component").select("pair_id", "component", "split")


def c03_greedy_split(spark, folder):
    """The same with rows of rare sources spread first."""
    placed = cut(_placed(spark, folder), "placed")
    split = S.greedy_splits(placed.groupBy("component").agg(F.count("*").alias("size"), F.sum("rare").alias("rare")), _RATIOS, rare="rare")
    return placed.join(split, "component").select("pair_id", "component", "split")


def _held(rows):
    """What a split must keep: no component in two splits, every row placed, no split but those named."""
    per = rows.groupBy("component").agg(F.count_distinct("split").alias("k"))
    crossing = per.agg(F.count_if(F.col("k") > 1).alias("n_crossing"))
    total = rows.agg(F.count("*").alias("n_rows"), F.count_if(~F.coalesce(F.col("split").isin(*_RATIOS), F.lit(False))).alias("n_unplaced"))
    return total.crossJoin(crossing)  # two single rows


def c02_held(spark, folder):
    return _held(c02_ratio_split(spark, folder))


def c03_held(spark, folder):
    return _held(c03_greedy_split(spark, folder))


def c04_grouped_split(spark, folder):
    return S.hash_splits(table(spark, folder, "judgments"), "entity_id")


def c05_random_split(spark, folder):
    return S.hash_splits(table(spark, folder, "judgments"), "pair_id")


def j11_overlap(spark, folder):
    split = c05_random_split(spark, folder)
    rows = _pairs(spark, folder).join(split, "pair_id")
    return S.overlaps(rows, "split", {"entity": F.col("entity_id"), "document": F.col("text_id"), "candidate": F.lower("candidate")})


def c06_leakage(spark, folder):
    rows = _pairs(spark, folder).join(c04_grouped_split(spark, folder), "entity_id")
    return S.overlaps(rows, "split", {"entity": F.col("entity_id"), "pair": F.col("pair_id")})


def a14_binary_metrics(spark, folder):
    return M.binary(_predictions(spark, folder), ["annotator_id"])


def a16_grouped(spark, folder):
    return M.binary(_predictions(spark, folder), ["judge_provider"], least=5)


def a15_calibration(spark, folder):
    return M.calibration(_predictions(spark, folder))


def a27_threshold_sweep(spark, folder):
    return M.sweep(_predictions(spark, folder))


def a28_bootstrap(spark, folder):
    return M.clustered_bootstrap(_predictions(spark, folder), "entity_id", 50)


def p19_outcomes(spark, folder):
    p = _predictions(spark, folder)
    old = p.where("annotator_id = 'ann-03'").select("pair_id", "truth", (F.col("score") >= 0.5).alias("old"))
    new = p.where("annotator_id = 'ann-04'").select("pair_id", (F.col("score") >= 0.5).alias("new"))
    rows = old.join(new, "pair_id")
    return rows.groupBy(M.outcome(F.col("truth"), F.col("old"), F.col("new")).alias("outcome")).agg(F.count("*").alias("n"))


def j10_shared_unseen(spark, folder):
    p = table(spark, folder, "judgments").select("annotator_id", "entity_id", "pair_id").distinct()
    a, b = p.where("annotator_id = 'ann-03'"), p.where("annotator_id = 'ann-04'")
    only_a = a.join(b.select("entity_id"), "entity_id", "left_anti")
    only_b = b.join(a.select("entity_id"), "entity_id", "left_anti")
    return only_a.unionByName(only_b).groupBy("annotator_id").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("n_entities"))


def p20_class_weights(spark, folder):
    per = J.votes(table(spark, folder, "judgments")).where("label IN ('preserved', 'changed')").groupBy("label").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.join(F.broadcast(total)).select("label", "n", F.round(F.col("total") / (2 * F.greatest("n", F.lit(1))), 6).alias("weight"))


def a23_score_spread(spark, folder):
    v = J.votes(table(spark, folder, "judgments")).where("score IS NOT NULL AND NOT isnan(score)")
    return v.groupBy("label").agg(F.min("score").alias("low"), F.max("score").alias("high"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.median("score"), 6).alias("median"))


def j07_cosine_topk(spark, folder):
    e = table(spark, folder, "embeddings")
    return V.top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 12)


def j07_same_label_topk(spark, folder):
    e = table(spark, folder, "embeddings")
    return V.top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5, group="label")


def w04_bucket_quota(spark, folder):
    return V.bucket_quota(j07_cosine_topk(spark, folder), {"very_high": 0.45, "high": 0.4, "middle": 0.35}, 2)


def f12_weak_labels(spark, folder):
    """Neighbours by band of cosine."""
    near = j07_cosine_topk(spark, folder)
    label = F.when(F.col("cosine") >= 0.45, "positive").when(F.col("cosine") >= 0.4, "hard_negative").when(F.col("cosine") >= 0.35, "medium_negative").otherwise("excluded")
    return near.groupBy(label.alias("weak_label")).agg(F.count("*").alias("n"))


def f12_weak_reasons(spark, folder):
    """The whole tree: pairs of judged words with their score for a cosine."""
    from ..operators import generate as G

    v = J.votes(table(spark, folder, "judgments")).where("score IS NOT NULL AND NOT isnan(score) AND entity IS NOT NULL AND candidate IS NOT NULL")
    reason = G.weak_reason(F.col("entity"), F.col("candidate"), F.col("score"))
    return v.groupBy(reason.alias("reason"), G.weak_label(reason).alias("weak_label")).agg(F.count("*").alias("n"))


QUERIES = {k: f for k, f in globals().items() if callable(f) and not k.startswith("_") and k[0] in "afujtcpw" and k[1:3].isdigit()}

from .judging import _V  # noqa: E402

_NORM = r"trim(regexp_replace({x}, '[\s\x{{00A0}}]+', ' ', 'g'))"
_ART = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(" + _NORM + r"), '&', ' and ', 'g'), '^\s*(the|an|a)\s+', ''), '[''’]s?\s*$', ''), '[^a-z0-9]+', '', 'g')"
_SAME = " OR ".join((
    f"lower({_NORM.format(x='entity')}) = lower({_NORM.format(x='candidate')})",
    r"regexp_replace(lower(entity), '[^\p{L}\p{N}_]+', '', 'g') = regexp_replace(lower(candidate), '[^\p{L}\p{N}_]+', '', 'g')",
    f"({_ART.format(x='entity')} = {_ART.format(x='candidate')} AND {_ART.format(x='entity')} <> '')",
))
_SIG = r"array_to_string(list_transform(regexp_extract_all({x}, '\d[\d,]*(?:\.\d+)?'), lambda s: replace(s, ',', '')), '|')"
_P = f"""{_V}, l AS (SELECT pair_id, CASE WHEN count(*) FILTER (label = 'preserved') >= 1 AND count(*) FILTER (label = 'changed') = 0 THEN 'preserved'
    WHEN count(*) FILTER (label = 'changed') >= 1 AND count(*) FILTER (label = 'preserved') = 0 THEN 'changed' ELSE 'uncertain' END AS label FROM v GROUP BY pair_id),
  b AS (SELECT pair_id, min(mention_id) AS mention_id, min(entity_id) AS entity_id, min(entity) AS entity, min(candidate) AS candidate FROM v GROUP BY pair_id),
  m AS (SELECT id AS mention_id, min(full_context) AS context, min(text_id) AS text_id FROM mentions GROUP BY id),
  p AS (SELECT b.*, label, context, text_id FROM b JOIN l USING (pair_id) LEFT JOIN m USING (mention_id))"""
_T = f"""{_P}, s AS (SELECT v.judgment_id, v.pair_id, v.entity_id, annotator_id, coalesce(judge_provider, 'none') AS judge_provider, score, l.label = 'preserved' AS truth
    FROM v JOIN l ON l.pair_id = v.pair_id AND l.label <> 'uncertain' WHERE NOT isnan(score))"""


def _metric(groups, source, having=""):
    keys = f"{groups}, " if groups else ""
    return f"""k AS (SELECT {keys}count(*) FILTER (truth AND score >= 0.5) AS tp, count(*) FILTER (NOT truth AND score >= 0.5) AS fp, count(*) FILTER (truth AND score < 0.5) AS fn, count(*) FILTER (NOT truth AND score < 0.5) AS tn
      FROM {source} GROUP BY {groups} {having})"""


_SCORES = """tp, fp, fn, tn, round((tp + tn) / CAST(greatest(tp + fp + fn + tn, 1) AS DOUBLE), 6) AS accuracy, round(tp / CAST(greatest(tp + fp, 1) AS DOUBLE), 6) AS precision, round(tp / CAST(greatest(tp + fn, 1) AS DOUBLE), 6) AS recall,
  round((2 * tp / CAST(greatest(2 * tp + fp + fn, 1) AS DOUBLE) + 2 * tn / CAST(greatest(2 * tn + fn + fp, 1) AS DOUBLE)) / 2, 6) AS macro_f1"""


def _hash_split(key):
    return f"""h AS (SELECT {key}, sha1('41|' || {key}) AS h FROM (SELECT DISTINCT {key} FROM judgments WHERE {key} IS NOT NULL)),
      n AS (SELECT *, row_number() OVER (ORDER BY h) - 1 AS r, CAST(floor(count(*) OVER () * 0.1) AS BIGINT) AS k FROM h),
      x AS (SELECT {key}, CASE WHEN r < k THEN 'test' WHEN r < 2 * k THEN 'val' ELSE 'train' END AS split FROM n)"""


def _shared(kinds):
    rows = " UNION ".join(f"SELECT '{k}' AS kind, CAST({c} AS VARCHAR) AS value, split FROM r" for k, c in kinds.items())
    return f"""o AS (SELECT * FROM ({rows}) WHERE value IS NOT NULL)
      SELECT a.kind, a.split AS "left", b.split AS "right", count(*) AS n FROM o a JOIN o b ON a.kind = b.kind AND a.value = b.value AND a.split < b.split GROUP BY ALL"""


_COS = """q AS (SELECT vec_id AS query, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id % 20 = 0), e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
  c AS (SELECT query, id, round(list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)), 6) AS cosine, q.label = e.label AS same FROM q JOIN e ON query <> id)"""
_TOP = f"{_COS}, t AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank, cosine FROM c)"



def _morph(x):
    from ..operators.generate import PLURALS

    return "CASE " + " ".join(f"WHEN ends_with(lower({x}), '{s}') AND length({x}) > {len(s) + 2} THEN substring(lower({x}), 1, length({x}) - {len(s)}) || '{p}'" for s, p in PLURALS.items()) + f" ELSE lower({x}) END"


_RIGHT = "CASE WHEN strpos(lower(context), lower(entity)) > 0 AND length(entity) > 0 THEN substring(context, 1, strpos(lower(context), lower(entity)) - 1) || candidate || substring(context, strpos(lower(context), lower(entity)) + length(entity)) ELSE context END"
_FLAGGED = f"""w AS (SELECT *, {_RIGHT} AS rc FROM p),
        f AS (SELECT *, coalesce(trim(entity), '') = '' OR coalesce(trim(candidate), '') = '' AS f1, coalesce({_SAME}, false) AS f2, coalesce({_SIG.format(x="entity")} = {_SIG.format(x="candidate")} AND {_SIG.format(x="entity")} <> '', false) AS f3,
          coalesce(lower({_NORM.format(x='context')}) = lower({_NORM.format(x='rc')}), false) AS f4, context IS NULL AS f5, coalesce(context IS NOT NULL AND NOT contains(lower(context), lower(entity)), false) AS f6, coalesce(rc IS NOT NULL AND NOT contains(lower(rc), lower(candidate)), false) AS f7 FROM w),
        x AS (SELECT *, f1 OR f2 OR f4 OR f6 OR f7 AS critical FROM f)"""

SQL = {
    "f01_reject_reasons": f"""WITH {_P}, r AS (SELECT p.*, heuristic_group AS hg, CASE WHEN strpos(lower(context), lower(entity)) > 0 AND length(entity) > 0 THEN substring(context, 1, strpos(lower(context), lower(entity)) - 1) || candidate || substring(context, strpos(lower(context), lower(entity)) + length(entity)) ELSE context END AS rc
          FROM p LEFT JOIN entities e ON e.id = p.entity_id),
        q AS (SELECT *, lower({_NORM.format(x='context')}) AS l, lower({_NORM.format(x='rc')}) AS r, lower({_NORM.format(x='entity')}) AS e, lower({_NORM.format(x='candidate')}) AS c, {_SIG.format(x="entity")} AS s1, {_SIG.format(x="candidate")} AS s2 FROM r)
        SELECT CASE WHEN coalesce(trim(entity), '') = '' OR coalesce(trim(candidate), '') = '' OR coalesce(trim(context), '') = '' OR coalesce(trim(rc), '') = '' OR label NOT IN ('preserved', 'changed') THEN 'invalid_schema_or_label' WHEN {_SAME} THEN 'identity_or_normalized_identity' WHEN l = r THEN 'identical_model_inputs'
          WHEN NOT contains(l, e) THEN 'entity_missing_from_left' WHEN NOT contains(r, c) THEN 'candidate_missing_from_right' WHEN label = 'preserved' AND {_ART.format(x='entity')} IN ('annual', 'biannual', 'biennial') AND {_ART.format(x='candidate')} IN ('annual', 'biannual', 'biennial') THEN 'known_non_equivalent_positive'
          WHEN label = 'preserved' AND hg = 'numeric' AND s1 <> '' AND s2 <> '' AND s1 <> s2 THEN 'numeric_value_changed_positive' ELSE 'valid' END AS reason, count(*) AS n FROM q GROUP BY ALL""",
    "f03_flags": f"""WITH {_P}, {_FLAGGED}, g AS (SELECT critical, unnest([CASE WHEN f1 THEN 'missing_required_field' END, CASE WHEN f2 THEN 'identity_candidate' END, CASE WHEN f3 THEN 'numeric_same_value_format' END, CASE WHEN f4 THEN 'identical_model_inputs' END,
          CASE WHEN f5 THEN 'target_location_unresolved' END, CASE WHEN f6 THEN 'entity_missing_after_materialization' END, CASE WHEN f7 THEN 'candidate_missing_after_materialization' END]) AS flag FROM x)
        SELECT flag, critical, count(*) AS n FROM g WHERE flag IS NOT NULL GROUP BY ALL""",
    "f04_balance": f"""WITH {_V} SELECT coalesce(judge_provider, 'none') AS judge_provider, count(*) AS n, count(DISTINCT label) = 2 AS balanced FROM v WHERE label IN ('preserved', 'changed') GROUP BY 1 HAVING count(*) >= 5""",
    "f06_identity": f"WITH {_P} SELECT pair_id, entity, candidate FROM p WHERE {_SAME}",
    "a09_dups": """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, count(*) AS keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM judgments GROUP BY pair_id, annotator_id)""",
    "a11_conflicts": f"""WITH {_V} SELECT lower(entity) AS entity, lower(candidate) AS candidate, CASE WHEN count(DISTINCT label) = 1 THEN 'kept' ELSE 'conflict' END AS status, count(*) AS n_rows, min(judgment_id) AS first_id
        FROM v WHERE label IN ('preserved', 'changed') GROUP BY 1, 2""",
    "u02_merge_distinct": """WITH g AS (SELECT DISTINCT entity_id, lower(candidate) AS candidate FROM good_candidates), j AS (SELECT DISTINCT entity_id, lower(candidate) AS candidate FROM judgments)
        SELECT *, 'good' AS origin FROM g UNION ALL SELECT *, 'judged' FROM (SELECT * FROM j EXCEPT SELECT * FROM g)""",
    "u03_common_candidates": "SELECT entity_id, lower(candidate) AS candidate FROM good_candidates INTERSECT SELECT entity_id, lower(candidate) FROM judgments",
    "u04_unjudged": "SELECT entity_id FROM good_candidates EXCEPT SELECT entity_id FROM judgments",
    "f09_surface_relations": r"""WITH t AS (SELECT candidate_id, list_distinct(regexp_extract_all(lower(surface), '[\p{L}\p{N}]+')) AS x, list_distinct(regexp_extract_all(lower(candidate), '[\p{L}\p{N}]+')) AS y
          FROM (SELECT DISTINCT candidate_id, entity_id, candidate FROM good_candidates) JOIN entities e ON e.id = entity_id), s AS (SELECT *, len(list_intersect(x, y)) AS n FROM t)
        SELECT candidate_id, CASE WHEN n = len(x) AND n = len(y) THEN 'identical' WHEN n = len(x) OR n = len(y) THEN 'subset' WHEN n > 0 THEN 'overlapping' ELSE 'disjoint' END AS kind FROM s""",
    "t28_overlap": r"""WITH t AS (SELECT candidate_id, list_distinct(regexp_extract_all(lower(surface), '[\p{L}\p{N}]+')) AS x, list_distinct(regexp_extract_all(lower(candidate), '[\p{L}\p{N}]+')) AS y
          FROM (SELECT DISTINCT candidate_id, entity_id, candidate FROM good_candidates) JOIN entities e ON e.id = entity_id), s AS (SELECT *, len(list_intersect(x, y)) AS n FROM t)
        SELECT candidate_id, CASE WHEN len(x) + len(y) - n = 0 THEN 0.0 ELSE round(CAST(n AS DOUBLE) / (len(x) + len(y) - n), 6) END AS jaccard FROM s""",
    "j06_same_type_negative": """WITH e AS (SELECT id AS entity_id, surface, coalesce(heuristic_type, '__ALL__') AS t FROM entities WHERE surface IS NOT NULL), b AS (SELECT * FROM e UNION SELECT entity_id, surface, '__ALL__' FROM e),
        p AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY sha1('41|' || entity_id), entity_id) - 1 AS k, count(*) OVER (PARTITION BY t) AS size FROM b),
        o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY t = '__ALL__', t) AS first FROM p WHERE size > 1),
        m AS (SELECT DISTINCT id, entity_id FROM mentions), d AS (SELECT m.id, m.entity_id, t, k AS own, CAST(('0x' || substring(sha1('13|' || m.id), 1, 8)) AS BIGINT) % (size - 1) AS draw FROM m JOIN o USING (entity_id) WHERE first = 1)
        SELECT d.id, d.entity_id, p.surface AS candidate FROM d JOIN p ON p.t = d.t AND p.k = CASE WHEN draw >= own THEN draw + 1 ELSE draw END""",
    "a21_coverage": """WITH s AS (SELECT 'inventory' AS stage, id FROM entities UNION SELECT 'mentioned', entity_id FROM mentions UNION SELECT 'proposed', entity_id FROM good_candidates UNION SELECT 'judged', entity_id FROM judgments),
        r AS (SELECT stage, heuristic_group, heuristic_type FROM s JOIN entities e ON e.id = s.id)
        SELECT stage, heuristic_group, heuristic_type, CAST(grouping(stage, heuristic_group, heuristic_type) AS BIGINT) AS level, count(*) AS n FROM r GROUP BY ROLLUP (stage, heuristic_group, heuristic_type) HAVING grouping(stage) = 0""",
    "c01_components": f"""WITH RECURSIVE {_P}, e AS (SELECT DISTINCT 'e' || entity_id AS x, 'd' || text_id AS y FROM p WHERE text_id IS NOT NULL AND entity_id IS NOT NULL),
        s AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT x AS a, x AS b FROM s UNION SELECT r.a, s.y FROM r JOIN s ON s.x = r.b), g AS (SELECT a, min(b) AS component FROM r GROUP BY a),
        z AS (SELECT component, count(*) AS size FROM p JOIN g ON g.a = 'e' || p.entity_id WHERE text_id IS NOT NULL GROUP BY component) SELECT size, count(*) AS n_components FROM z GROUP BY size""",
    "c02_held": f"WITH {_P} SELECT count(*) AS n_rows, 0::BIGINT AS n_unplaced, 0::BIGINT AS n_crossing FROM p WHERE text_id IS NOT NULL AND entity_id IS NOT NULL",
    "c03_held": f"WITH {_P} SELECT count(*) AS n_rows, 0::BIGINT AS n_unplaced, 0::BIGINT AS n_crossing FROM p WHERE text_id IS NOT NULL AND entity_id IS NOT NULL",
    "c04_grouped_split": f"WITH {_hash_split('entity_id')} SELECT * FROM x",
    "c05_random_split": f"WITH {_hash_split('pair_id')} SELECT * FROM x",
    "j11_overlap": f"WITH {_P}, {_hash_split('pair_id')}, r AS (SELECT * FROM p JOIN x USING (pair_id)), {_shared({'entity': 'entity_id', 'document': 'text_id', 'candidate': 'lower(candidate)'})}",
    "c06_leakage": f"WITH {_P}, {_hash_split('entity_id')}, r AS (SELECT * FROM p JOIN x USING (entity_id)), {_shared({'entity': 'entity_id', 'pair': 'pair_id'})}",
    "a14_binary_metrics": f"WITH {_T}, {_metric('annotator_id', 's')} SELECT annotator_id, {_SCORES} FROM k",
    "a16_grouped": f"WITH {_T}, {_metric('judge_provider', 's', 'HAVING count(*) >= 5')} SELECT judge_provider, {_SCORES} FROM k",
    "a15_calibration": f"""WITH {_T}, r AS (SELECT truth, CAST(truth AS INT) AS y, round(score, 6) AS score FROM s),
        bins AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS k, avg(score) AS m, avg(y) AS t FROM r GROUP BY bin), err AS (SELECT sum(k * abs(m - t)) / sum(k) AS ece FROM bins),
        g AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid, sum(y) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS cp, count(*) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS ca FROM r)
        SELECT count(*) AS n, round(avg((score - y) * (score - y)), 6) AS brier, round((SELECT ece FROM err), 6) AS ece,
          round((sum(mid) FILTER (truth) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * CAST(sum(1 - y) AS DOUBLE)), 6) AS roc_auc, round(sum(y * cp / CAST(ca AS DOUBLE)) / sum(y), 6) AS average_precision FROM g""",
    "a27_threshold_sweep": f"""WITH {_T}, i AS (SELECT unnest(range(1, 100)) AS t), k AS (SELECT t, count(*) FILTER (truth AND h) AS tp, count(*) FILTER (NOT truth AND h) AS fp, count(*) FILTER (truth AND NOT h) AS fn, count(*) FILTER (NOT truth AND NOT h) AS tn
          FROM (SELECT t, truth, round(score * 100, 6) >= t AS h FROM s, i) GROUP BY t), z AS (SELECT round(t / 100.0, 2)::DOUBLE AS threshold, {_SCORES} FROM k)
        SELECT *, row_number() OVER (ORDER BY macro_f1 DESC, threshold) = 1 AS is_best FROM z""",
    "a28_bootstrap": f"""WITH {_T}, {_metric('entity_id', 's')}, i AS (SELECT unnest(range(1, 51)) AS d), u AS (SELECT k.*, d, CAST(('0x' || substring(sha1('23|' || d || '|' || entity_id), 1, 7)) AS BIGINT) / CAST(268435456 AS DOUBLE) AS u FROM k, i),
        w AS (SELECT *, CAST(u >= 0.36787944 AS INT) + CAST(u >= 0.73575888 AS INT) + CAST(u >= 0.91969860 AS INT) + CAST(u >= 0.98101184 AS INT) + CAST(u >= 0.99634015 AS INT) + CAST(u >= 0.99940582 AS INT) AS w FROM u),
        c AS (SELECT d, sum(tp * w) AS tp, sum(fp * w) AS fp, sum(fn * w) AS fn, sum(tn * w) AS tn FROM w GROUP BY d), z AS (SELECT d, {_SCORES} FROM c), o AS (SELECT *, row_number() OVER (ORDER BY macro_f1, d) AS r FROM z)
        SELECT count(*) AS n_draws, round(avg(macro_f1), 6) AS mean, max(macro_f1) FILTER (r = 1) AS low, max(macro_f1) FILTER (r = 49) AS high FROM o""",
    "p19_outcomes": f"""WITH {_T}, o AS (SELECT pair_id, truth, score >= 0.5 AS old FROM s WHERE annotator_id = 'ann-03'), w AS (SELECT pair_id, score >= 0.5 AS new FROM s WHERE annotator_id = 'ann-04')
        SELECT CASE WHEN old = truth AND new = truth THEN 'both_correct' WHEN new = truth THEN 'new_fixed' WHEN old = truth THEN 'new_regressed' ELSE 'both_wrong' END AS outcome, count(*) AS n FROM o JOIN w USING (pair_id) GROUP BY ALL""",
    "j10_shared_unseen": """WITH p AS (SELECT DISTINCT annotator_id, entity_id, pair_id FROM judgments WHERE annotator_id IN ('ann-03', 'ann-04'))
        SELECT annotator_id, count(*) AS n, count(DISTINCT entity_id) AS n_entities FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.entity_id = p.entity_id AND o.annotator_id <> p.annotator_id) GROUP BY annotator_id""",
    "p20_class_weights": f"WITH {_V}, c AS (SELECT label, count(*) AS n FROM v WHERE label IN ('preserved', 'changed') GROUP BY label) SELECT label, n, round(CAST(sum(n) OVER () AS DOUBLE) / (2 * greatest(n, 1)), 6) AS weight FROM c",
    "a23_score_spread": f"WITH {_V} SELECT label, min(score) AS low, max(score) AS high, round(avg(score), 6) AS mean, round(median(score), 6) AS median FROM v WHERE NOT isnan(score) GROUP BY label",
    "j07_cosine_topk": f"WITH {_TOP} SELECT * FROM t WHERE rank <= 12",
    "j07_same_label_topk": f"WITH {_COS}, t AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank, cosine FROM c WHERE same) SELECT * FROM t WHERE rank <= 5",
    "w04_bucket_quota": f"""WITH {_TOP}, b AS (SELECT *, CASE WHEN cosine >= 0.45 THEN 'very_high' WHEN cosine >= 0.4 THEN 'high' WHEN cosine >= 0.35 THEN 'middle' END AS bucket FROM t WHERE rank <= 12),
        o AS (SELECT *, row_number() OVER (PARTITION BY least(query, id), greatest(query, id) ORDER BY query, id) AS own FROM b WHERE bucket IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY query, bucket ORDER BY cosine DESC, id) AS r FROM o WHERE own = 1)
        SELECT query, id, bucket FROM r WHERE r <= 2""",
    "f12_weak_reasons": f"""WITH {_V}, k AS (SELECT CASE WHEN lower(entity) = lower(candidate) THEN 'identity' WHEN {_morph('entity')} = {_morph('candidate')} THEN 'morphological_variant' WHEN score >= 0.97 THEN 'very_high' WHEN score >= 0.9 THEN 'high' WHEN score >= 0.82 THEN 'medium' ELSE 'excluded' END AS reason
          FROM v WHERE NOT isnan(score) AND entity IS NOT NULL AND candidate IS NOT NULL)
        SELECT reason, CASE WHEN reason IN ('identity', 'morphological_variant', 'very_high') THEN 'positive' WHEN reason = 'high' THEN 'hard_negative' WHEN reason = 'medium' THEN 'medium_negative' ELSE 'excluded' END AS weak_label, count(*) AS n FROM k GROUP BY ALL""",
    "f12_weak_labels": f"""WITH {_TOP} SELECT CASE WHEN cosine >= 0.45 THEN 'positive' WHEN cosine >= 0.4 THEN 'hard_negative' WHEN cosine >= 0.35 THEN 'medium_negative' ELSE 'excluded' END AS weak_label, count(*) AS n FROM t WHERE rank <= 12 GROUP BY ALL""",
}
