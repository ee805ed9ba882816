"""Queries that route, gate and report rows: reasons, names, labels, tags, heads, bootstraps."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as T
from ..operators import judging as J
from ..operators import metrics as M
from ..operators import names as N
from ..operators.cleaning import NOT_EQUIVALENT
from ..sources.tables import table
from .quality import _pairs, _predictions


def _named(spark, folder):
    e = table(spark, folder, "entities").select(F.col("id").alias("entity_id"), "surface", "heuristic_type")
    g = table(spark, folder, "good_candidates").groupBy("candidate_id").agg(*[F.min(c).alias(c) for c in ("entity_id", "candidate", "relation")])
    return g.where("candidate IS NOT NULL").join(e, "entity_id")


def f08_good_aliases(spark, folder):
    verdict = N.alias_verdict(F.col("surface"), F.col("candidate"), F.col("heuristic_type"), F.col("relation"))
    return _named(spark, folder).select("candidate_id", verdict.alias("verdict"))


def f09_hard_negatives(spark, folder):
    a, b, t = F.col("surface"), F.col("candidate"), F.col("heuristic_type")
    return _named(spark, folder).select(
        "candidate_id", F.round(N.negative_score(a, b, t), 6).alias("score"), N.same_entity_surface(a, b, t).alias("same_surface"), N.hard_negative(a, b, t).alias("hard_negative")
    )


def t28_roles(spark, folder):
    e = table(spark, folder, "entities").where("heuristic_group = 'proper_name' AND surface IS NOT NULL")
    return e.select("id", F.array_join(N.roles(F.col("surface")), "|").alias("roles"), F.array_join(F.array_sort(N.heads(F.col("surface"))), "|").alias("heads"), N.acronym(F.col("surface")).alias("acronym"))


def f02_known_pairs(spark, folder):
    """Judged and listed pairs of words, and whether they are known not to be equivalent, in either order."""
    listed = spark.createDataFrame([(a, b) for a, b in NOT_EQUIVALENT] + [(b, a) for a, b in NOT_EQUIVALENT], "entity string, candidate string")
    rows = table(spark, folder, "judgments").select("entity", "candidate").where("entity IS NOT NULL AND candidate IS NOT NULL").unionByName(listed).distinct()
    return rows.select("entity", "candidate", J.known_non_equivalent(F.col("entity"), F.col("candidate"), NOT_EQUIVALENT).alias("known"))


def f05_gate(spark, folder):
    """One row: critical rows, groups without both labels, the exit code and what to do."""
    from ..operators import cleaning as C

    found = C.flags(F.col("entity"), F.col("candidate"), F.col("context"), T.replace_first(F.col("context"), F.col("entity"), F.col("candidate")))
    rows = _pairs(spark, folder)
    critical = rows.agg(F.count_if(F.size(C.critical(found)) > 0).alias("n_critical"), F.count("*").alias("n_rows"))
    groups = C.balance(rows.withColumn("judge_provider", F.coalesce("judge_provider", F.lit("none"))), "judge_provider", "label", 5)
    both = critical.crossJoin(groups.agg(F.count_if(~F.col("balanced")).alias("n_unbalanced")))  # two single rows
    bad = (F.col("n_critical") > 0) | (F.col("n_unbalanced") > 0)
    return both.select("n_rows", "n_critical", "n_unbalanced", F.when(bad, 3).otherwise(0).cast("long").alias("exit_code"), F.when(bad, "fix_or_drop_flagged_rows").otherwise("ready").alias("recommendation"))


def a07_audit(spark, folder):
    """Per provider: rows, labels, identities and flagged rows."""
    from ..operators import cleaning as C

    rows = _pairs(spark, folder).withColumn("judge_provider", F.coalesce("judge_provider", F.lit("none")))
    found = C.flags(F.col("entity"), F.col("candidate"), F.col("context"), T.replace_first(F.col("context"), F.col("entity"), F.col("candidate")))
    return rows.groupBy("judge_provider").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == "preserved").alias("n_preserved"), F.count_if(F.col("label") == "changed").alias("n_changed"),
        F.count_if(C.same_identity(F.col("entity"), F.col("candidate"))).alias("n_identity"), F.count_if(F.size(C.critical(found)) > 0).alias("n_critical"),
        F.count_if(F.col("context").isNull()).alias("n_without_context"),
    )


def a06_expected(spark, folder):
    """Explicit expectations (scores of 0.9 and more, 0.1 and less) against the labels: overall and per label."""
    v = J.votes(table(spark, folder, "judgments")).where("score IS NOT NULL AND NOT isnan(score) AND label <> 'missing'")
    rows = v.withColumn("expected", R.band(F.col("score"))).where("expected <> 'uncertain'")
    return rows.rollup("expected").agg(F.count("*").alias("n"), F.count_if(F.col("expected") == F.col("label")).alias("n_matching")).select(F.coalesce("expected", F.lit("all")).alias("expected"), "n", "n_matching")


def a18_averages(spark, folder):
    from .judging import a18_class_report

    c = a18_class_report(spark, folder).where("support > 0")
    total = F.sum("support")
    return c.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / total, 6).alias("weighted_f1"), F.count("*").alias("n_classes"), total.alias("n"))


def a28_comparison(spark, folder):
    """Old against new model (two annotators' scores): 1000 draws of entities, the interval of the difference, and how often the new is better."""
    p = _predictions(spark, folder)
    old = p.where("annotator_id = 'ann-03'").select("pair_id", "entity_id", "truth", F.col("score").alias("old"))
    new = p.where("annotator_id = 'ann-04'").select("pair_id", F.col("score").alias("new"))
    return M.bootstrap_comparison(old.join(new, "pair_id"), "entity_id", 1000)


def j15_type_comparison(spark, folder):
    """Macro F1 per entity type of two annotators, and the difference, for types that both have."""
    t = table(spark, folder, "entities").select(F.col("id").alias("entity_id"), "heuristic_type")
    p = _predictions(spark, folder).join(t, "entity_id").where("heuristic_type IS NOT NULL")
    per = M.binary(p.where("annotator_id IN ('ann-03', 'ann-04')"), ["annotator_id", "heuristic_type"]).select("annotator_id", "heuristic_type", "macro_f1")
    old, new = (per.where(F.col("annotator_id") == a).select("heuristic_type", F.col("macro_f1").alias(c)) for a, c in (("ann-03", "old_f1"), ("ann-04", "new_f1")))
    return old.join(new, "heuristic_type").select("heuristic_type", "old_f1", "new_f1", F.round(F.col("new_f1") - F.col("old_f1"), 6).alias("delta"))


def p04_local_labels(spark, folder):
    """The label of a row: its own, else the weak one, else the expected score if that is 0 or 1."""
    v = J.votes(table(spark, folder, "judgments"))
    own = F.when(F.col("label") == "preserved", 1).when(F.col("label") == "changed", 0)
    weak = F.when(F.lower("entity") == F.lower("candidate"), 1)
    expected = F.when(F.col("score").isin(0.0, 1.0), F.col("score").cast("int"))
    return v.select("judgment_id", F.coalesce(own, weak, expected).cast("long").alias("label"))


def p05_offline(spark, folder):
    """Rows with a local label under their source's name, and how many of a source have none."""
    v = J.votes(table(spark, folder, "judgments")).withColumn("source", F.coalesce("judge_provider", F.lit("none")))
    labelled = v.join(p04_local_labels(spark, folder).withColumnRenamed("label", "number"), "judgment_id")
    source = F.concat(F.lit("offline_"), F.col("source"))
    how = F.when(F.col("number").isNull(), F.concat("source", F.lit(":missing_local_label"))).otherwise(F.concat(source, F.lit("_weak_or_rule")))
    return labelled.groupBy(source.alias("corpus_source"), how.alias("annotation_source"), F.col("number").isNotNull().alias("kept")).agg(F.count("*").alias("n"))


def p06_train_projection(spark, folder):
    """Training rows of clear pairs: names, ids, types, consensus and where they come from; uncertain ones are left out."""
    p = _pairs(spark, folder).where("label <> 'uncertain'")
    e = table(spark, folder, "entities").select(F.col("id").alias("entity_id"), "heuristic_type", "heuristic_group", "context_policy")
    t = table(spark, folder, "texts").select(F.col("id").alias("text_id"), "dataset_id", "row_idx", "source_id")
    d = table(spark, folder, "datasets").select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset"), "split", "domain")
    rows = p.join(e, "entity_id", "left").join(t, "text_id", "left").join(F.broadcast(d), "dataset_id", "left")  # datasets: a fixed small table
    right = T.replace_first(F.col("context"), F.col("entity"), F.col("candidate"))
    return rows.select(
        "pair_id", F.when(F.col("label") == "preserved", 1).otherwise(0).cast("long").alias("label"), F.col("label").alias("consensus_label"), F.round("score", 6).alias("consensus_score"),
        "entity", "candidate", "entity_id", "mention_id", "text_id", "dataset_id", "row_idx", "source_id", "dataset", F.col("split").alias("dataset_split"), "domain",
        F.col("heuristic_type").alias("entity_type"), F.col("heuristic_group").alias("coarse_group"), "context_policy", F.md5("context").alias("left_md5"), F.md5(right).alias("right_md5"),
    )


# Groups and policies that a tag may have.
GROUPS = ("proper_name", "numeric", "common_entity", "domain_term", "ambiguous", "junk")
POLICIES = ("short_window", "full_context", "no_context_embedding", "agent_review", "drop")
FINE = (
    "PERSON ORG GPE LOC FAC NORP EVENT LAW PRODUCT WORK_OF_ART DATE TIME CARDINAL ORDINAL MONEY PERCENT QUANTITY COMMON_NOUN DOMAIN_TERM OTHER UNKNOWN JUNK"
).split()


def p14_fallback_tags(spark, folder):
    """The tag of an entity whose annotation failed: its heuristics where they are allowed values, a low confidence, a short reason."""
    e = table(spark, folder, "entities")
    first = F.regexp_extract("observed_types_json", r'"([^"]+)"\s*:', 1)
    reason = F.concat(F.lit("Heuristic fallback after provider/alignment failure: "), F.coalesce("surface", F.lit("")))
    return e.select(
        F.col("id").cast("string").alias("entity_id"), F.when(F.col("heuristic_group").isin(*GROUPS), F.col("heuristic_group")).otherwise("ambiguous").alias("coarse_group"),
        F.when(first.isin(*FINE), first).otherwise("UNKNOWN").alias("fine_type"), F.when(F.col("context_policy").isin(*POLICIES), F.col("context_policy")).otherwise("agent_review").alias("context_policy"),
        F.lit(0.35).alias("confidence"), T.clip(reason, 240).alias("rationale"),
    )


def p21_sample_weights(spark, folder):
    """0.4 for rows whose label is only weak, 1 for the others."""
    v = J.votes(table(spark, folder, "judgments"))
    weak = F.col("rationale").isNull() & F.col("judge_provider").isNull()
    return v.select("judgment_id", F.when(weak, 0.4).otherwise(1.0).alias("weight"))


def w05_accepted(spark, folder):
    """Of each mention, the first three different candidates that pass, by rank of score."""
    v = J.votes(table(spark, folder, "judgments")).where("mention_id IS NOT NULL AND candidate IS NOT NULL")
    ok = v.where((F.lower("candidate") != F.lower("entity")) & F.col("score").isNotNull() & ~F.isnan("score"))
    best = ok.groupBy("mention_id", F.lower("candidate").alias("candidate")).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("mention_id").orderBy(F.desc("score"), "candidate"))
    return best.withColumn("rank", rank).where("rank <= 3").select("mention_id", "candidate", "score", F.col("rank").cast("long").alias("rank"))


def n09_log_probabilities(spark, folder):
    """Mean, sum and least of a sequence's log probabilities, and the change against the first half."""
    e = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("p"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    half = F.slice("p", F.lit(1), F.floor(F.size("p") / 2).cast("int"))
    mean, first = total(F.col("p")) / F.size("p"), total(half) / F.size(half)
    return e.select("vec_id", F.round(mean, 6).alias("avg"), F.round(total(F.col("p")), 6).alias("sum"), F.round(F.array_min("p"), 6).alias("min"), F.round(mean - first, 6).alias("delta"), F.round(F.exp(mean), 6).alias("probability"))


def n10_softmax(spark, folder):
    """The class of the highest of three heads' probabilities."""
    e = table(spark, folder, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: F.exp(8 * x.cast("double"))).alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, x: a + x)
    shares = e.select("vec_id", F.transform("x", lambda v: v / total).alias("s"))
    return shares.select("vec_id", (F.array_position("s", F.array_max("s")) - 1).cast("long").alias("head"), F.round(F.array_max("s"), 6).alias("probability"))


def a30_checkpoint(spark, folder):
    """The best of several runs (annotators): macro F1 of the labels plus a fifth of that of the directions; the first of equals."""
    p = M.binary(_predictions(spark, folder), ["annotator_id"]).select("annotator_id", "macro_f1")
    d = table(spark, folder, "directional_judgments").distinct().select("annotator_id", R.relation(F.col("a_to_b"), F.col("b_to_a")).alias("derived"), "relation")
    heads = d.groupBy("annotator_id").agg(F.count("*").alias("n"), F.avg(F.col("relation").eqNullSafe(F.col("derived")).cast("double")).alias("share"))
    score = F.col("macro_f1") + 0.2 * F.coalesce(F.when(F.col("n") >= 20, F.col("share")), F.lit(0.0))
    rows = p.join(heads, "annotator_id", "left").select("annotator_id", F.round(score, 6).alias("score"))
    return rows.withColumn("best", F.row_number().over(Window.orderBy(F.desc("score"), "annotator_id")) == 1)


def l03_seeded_sample(spark, folder):
    """A fixed number of rows in the order of a seeded hash."""
    d = table(spark, folder, "documents").select("doc_id").distinct()
    draw = F.sha1(F.concat_ws("|", F.lit("29"), F.col("doc_id").cast("string")))
    return d.withColumn("h", draw).orderBy("h", "doc_id").limit(50).select("doc_id")


def m07_unordered_pairs(spark, folder):
    """How often two names are compared, in either order."""
    j = table(spark, folder, "judgments").where("entity IS NOT NULL AND candidate IS NOT NULL").select("pair_id", F.lower("entity").alias("a"), F.lower("candidate").alias("b")).distinct()
    return j.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count_distinct("pair_id").alias("n"))


def j18_mention_ranking(spark, folder):
    """Ranking pairs inside a mention, numbered negatives instead of all pairs."""
    rows = J.consensus(J.votes(table(spark, folder, "judgments")), 1, 1).select("pair_id", "label")
    mention = table(spark, folder, "judgments").where("mention_id IS NOT NULL").groupBy("pair_id").agg(F.min("mention_id").alias("mention_id"))
    return J.ranking_pairs(rows.join(mention, "pair_id"), "mention_id")


def j05_overlay_by_text(spark, folder):
    """Directions laid over rows by entity and candidate; keys with conflicting directions are left out."""
    named = J.votes(table(spark, folder, "judgments")).groupBy("pair_id").agg(F.min("entity").alias("entity"), F.min("candidate").alias("candidate"))
    d = table(spark, folder, "directional_judgments").distinct().where("a_to_b IS NOT NULL AND b_to_a IS NOT NULL").join(named, "pair_id")
    key = F.concat_ws("\x1f", T.norm_key(F.col("entity")), T.norm_key(F.col("candidate")))
    over = J.overlay(d.withColumn("key", key), ["a_to_b", "b_to_a"], "key")
    return named.withColumn("key", key).join(over, "key").select("pair_id", "a_to_b", "b_to_a")


def j08_lexicon_topk(spark, folder):
    """Every twentieth vector against a lexicon of labelled vectors: the nearest three of another label."""
    from ..operators import vectors as V

    e = table(spark, folder, "embeddings")
    near = V.top_k(e.where("vec_id % 20 = 0"), e.where("label < 5"), "vec_id", "embedding", 3)
    return near


QUERIES = {k: f for k, f in globals().items() if callable(f) and k[0] in "aftpwnljm" and k[1:3].isdigit()}

from .judging import SQL as _JS, _D, _V, ranking_sql  # noqa: E402
from .quality import _COS, _FLAGGED, _P, _SCORES, _SAME, _T, _metric  # noqa: E402

_NORM = r"trim(regexp_replace({x}, '[\s\x{{00A0}}]+', ' ', 'g'))"
_KEY = r"regexp_replace(lower(" + _NORM + r"), '[^\p{{L}}\p{{N}}_%$£€]+', '', 'g')"
_LIT = "lower(" + _NORM + ")"
_ART = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(" + _NORM + r"), '&', ' and ', 'g'), '^\s*(the|an|a)\s+', ''), '[''’]s?\s*$', ''), '[^a-z0-9]+', '', 'g')"
_COMPACT = r"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]+', '', 'g')"
_WORDS = "regexp_extract_all({x}, '[A-Za-zА-Яа-я0-9]+')"
_LOWWORDS = "list_distinct(list_transform(" + _WORDS + ", lambda w: lower(w)))"
_CONTENT = "list_distinct(list_filter(regexp_extract_all(replace(" + _LIT + ", 'u.s.', 'us'), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(f"'{w}'" for w in N.STOPS) + ")))"
_ROLES = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({_LIT}, '{p}') THEN '{n}' END" for n, p in N.ROLES.items()) + "], lambda r: r IS NOT NULL)"
_HEADS = "list_intersect(" + _LOWWORDS + ", [" + ", ".join(f"'{h}'" for h in N.HEADS) + "])"
_ACR = "(length(regexp_replace({x}, '[^A-Za-z]', '', 'g')) BETWEEN 2 AND 12 AND upper(regexp_replace({x}, '[^A-Za-z]', '', 'g')) = regexp_replace({x}, '[^A-Za-z]', '', 'g'))"
_NAMED = f"""g AS (SELECT candidate_id, min(entity_id) AS entity_id, min(candidate) AS b, min(relation) AS relation FROM good_candidates GROUP BY candidate_id),
        n AS (SELECT candidate_id, b, relation, surface AS a, heuristic_type AS t FROM g JOIN entities e ON e.id = g.entity_id WHERE b IS NOT NULL),
        k AS (SELECT *, {_LIT.format(x='a')} = {_LIT.format(x='b')} OR {_COMPACT.format(x='a')} = {_COMPACT.format(x='b')} OR {_ART.format(x='a')} = {_ART.format(x='b')} AS trivial, {_CONTENT.format(x='a')} AS ca, {_CONTENT.format(x='b')} AS cb,
          {_LOWWORDS.format(x='a')} AS wa, {_LOWWORDS.format(x='b')} AS wb, {_HEADS.format(x='a')} AS ha, {_HEADS.format(x='b')} AS hb, {_ROLES.format(x='a')} AS r1, {_ROLES.format(x='b')} AS r2, {_ART.format(x='a')} AS pa, {_ART.format(x='b')} AS pb FROM n),
        s AS (SELECT *, CAST(len(list_intersect(ca, cb)) AS DOUBLE) / greatest(len(list_distinct(list_concat(ca, cb))), 1) AS o, CASE WHEN len(r1) = 0 THEN ['other'] ELSE r1 END AS ra, CASE WHEN len(r2) = 0 THEN ['other'] ELSE r2 END AS rb FROM k),
        z AS (SELECT *, list_intersect(ra, rb) AS common FROM s),
        q AS (SELECT *, CASE WHEN t = 'LAW' THEN CASE WHEN list_contains(ra, 'law_act') AND list_contains(rb, 'law_act') THEN o + CASE WHEN o >= 0.1 THEN 0.55 ELSE -0.2 END ELSE -0.5 END
            ELSE o + CASE WHEN len(list_filter(common, lambda r: r NOT IN ('department_agency', 'nonprofit_association', 'other'))) > 0 THEN 0.45 WHEN len(common) > 0 AND NOT list_contains(common, 'other') THEN 0.18 ELSE 0 END
              - CASE WHEN coalesce(t = 'ORG', false) AND len(list_filter(common, lambda r: r <> 'department_agency')) = 0 THEN 0.2 ELSE 0 END - CASE WHEN ra = ['other'] AND rb = ['other'] AND o < 0.18 THEN 0.2 ELSE 0 END END AS score,
          len(wa) > 0 AND len(wb) > 0 AND ((coalesce(t = 'PERSON', false) AND (len(list_intersect(wa, wb)) = len(wa) OR len(list_intersect(wa, wb)) = len(wb))) OR (pa <> '' AND pb <> '' AND (contains(pa, pb) OR contains(pb, pa)) AND o >= 0.5)) AS same FROM z)"""
_LOCAL = "coalesce(CASE label WHEN 'preserved' THEN 1 WHEN 'changed' THEN 0 END, CASE WHEN lower(entity) = lower(candidate) THEN 1 END, CASE WHEN score IN (0.0, 1.0) THEN CAST(score AS INT) END)"

SQL = {
    "j18_mention_ranking": ranking_sql("mention_id") + " SELECT mention_id, substring(sha1(positive || chr(31) || negative), 1, 20) AS ranking_id, positive, negative FROM r",
    "f08_good_aliases": rf"""WITH {_NAMED} SELECT candidate_id, CASE WHEN trivial THEN 'trivial' WHEN t = 'PERSON' AND len({_WORDS.format(x='a')}) <= 1 THEN 'ambiguous_person'
        WHEN NOT (coalesce(relation IN ('abbreviation', 'acronym'), false) OR {_ACR.format(x='b')}) AND (regexp_matches({_LIT.format(x='b')}, '{N.LEGAL_PREFIX}')
          OR coalesce(t IN ('ORG', 'FAC') AND ((len(ha) > 0 AND len(hb) > 0 AND NOT list_has_any(ha, hb)) OR (list_has_any(ha, ['university', 'college', 'institute', 'school']) AND len({_WORDS.format(x='b')}) = 1 AND len(hb) = 0)), false)) THEN 'suspicious' ELSE 'good' END AS verdict FROM q""",
    "f09_hard_negatives": f"WITH {_NAMED} SELECT candidate_id, round(score, 6) AS score, same AS same_surface, NOT trivial AND score >= 0.35 AND NOT same AS hard_negative FROM q",
    "t28_roles": f"""SELECT id, CASE WHEN len({_ROLES.format(x='surface')}) = 0 THEN 'other' ELSE array_to_string({_ROLES.format(x='surface')}, '|') END AS roles, array_to_string(list_sort({_HEADS.format(x='surface')}), '|') AS heads, {_ACR.format(x='surface')} AS acronym
        FROM entities WHERE heuristic_group = 'proper_name' AND surface IS NOT NULL""",
    "f02_known_pairs": "WITH l(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in NOT_EQUIVALENT) + f"""), r AS (SELECT entity, candidate FROM judgments WHERE entity IS NOT NULL AND candidate IS NOT NULL UNION SELECT a, b FROM l UNION SELECT b, a FROM l)
        SELECT entity, candidate, EXISTS (SELECT 1 FROM l WHERE (l.a = {_ART.format(x='entity')} AND l.b = {_ART.format(x='candidate')}) OR (l.b = {_ART.format(x='entity')} AND l.a = {_ART.format(x='candidate')})) AS known FROM r""",
    "f05_gate": f"""WITH {_P}, {_FLAGGED}, u AS (SELECT count(*) FILTER (n < 2) AS n FROM (SELECT pr, count(DISTINCT label) AS n FROM (SELECT p.label, coalesce((SELECT min(judge_provider) FROM v WHERE v.pair_id = p.pair_id), 'none') AS pr FROM p) WHERE label IN ('preserved', 'changed') GROUP BY pr HAVING count(*) >= 5)),
        c AS (SELECT count(*) AS r, count(*) FILTER (critical) AS k FROM x)
        SELECT r AS n_rows, k AS n_critical, n AS n_unbalanced, CASE WHEN k > 0 OR n > 0 THEN 3 ELSE 0 END::BIGINT AS exit_code, CASE WHEN k > 0 OR n > 0 THEN 'fix_or_drop_flagged_rows' ELSE 'ready' END AS recommendation FROM c, u""",
    "a07_audit": f"""WITH {_P}, {_FLAGGED}, y AS (SELECT x.*, coalesce((SELECT min(judge_provider) FROM v WHERE v.pair_id = x.pair_id), 'none') AS pr FROM x)
        SELECT pr AS judge_provider, count(*) AS n, count(*) FILTER (label = 'preserved') AS n_preserved, count(*) FILTER (label = 'changed') AS n_changed, count(*) FILTER ({_SAME}) AS n_identity, count(*) FILTER (critical) AS n_critical, count(*) FILTER (context IS NULL) AS n_without_context FROM y GROUP BY pr""",
    "a06_expected": f"""WITH {_V}, k AS (SELECT label, CASE WHEN score >= 0.9 THEN 'preserved' WHEN score <= 0.1 THEN 'changed' END AS e FROM v WHERE NOT isnan(score) AND label <> 'missing')
        SELECT coalesce(e, 'all') AS expected, count(*) AS n, count(*) FILTER (e = label) AS n_matching FROM k WHERE e IS NOT NULL GROUP BY e
        UNION ALL SELECT 'all', count(*), count(*) FILTER (e = label) FROM k WHERE e IS NOT NULL""",
    "a18_averages": f"WITH r AS ({_JS['a18_class_report']}) SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, count(*) AS n_classes, CAST(sum(support) AS BIGINT) AS n FROM r WHERE support > 0",
    "a28_comparison": f"""WITH {_T}, o AS (SELECT pair_id, entity_id, truth, score AS old FROM s WHERE annotator_id = 'ann-03'), w AS (SELECT pair_id, score AS new FROM s WHERE annotator_id = 'ann-04'), r AS (SELECT * FROM o JOIN w USING (pair_id)),
        k AS (SELECT entity_id, {", ".join(f"count(*) FILTER ({t} AND {p}) AS {c}{m}" for m, col in (("a", "old"), ("b", "new")) for c, t, p in (("tp", "truth", f"{col} >= 0.5"), ("fp", "NOT truth", f"{col} >= 0.5"), ("fn", "truth", f"{col} < 0.5"), ("tn", "NOT truth", f"{col} < 0.5")))} FROM r GROUP BY entity_id),
        u AS (SELECT k.*, d, CAST(('0x' || substring(sha1('23|' || d || '|' || entity_id), 1, 7)) AS BIGINT) / CAST(268435456 AS DOUBLE) AS u FROM k, (SELECT unnest(range(1, 1001)) AS d)),
        g AS (SELECT *, CAST(u >= 0.36787944 AS INT) + CAST(u >= 0.73575888 AS INT) + CAST(u >= 0.91969860 AS INT) + CAST(u >= 0.98101184 AS INT) + CAST(u >= 0.99634015 AS INT) + CAST(u >= 0.99940582 AS INT) AS w FROM u),
        c AS (SELECT d, {", ".join(f"sum({c}{m} * w) AS {c}{m}" for m in "ab" for c in ("tp", "fp", "fn", "tn"))} FROM g GROUP BY d),
        f AS (SELECT d, {", ".join(f"round((2 * tp{m} / CAST(greatest(2 * tp{m} + fp{m} + fn{m}, 1) AS DOUBLE) + 2 * tn{m} / CAST(greatest(2 * tn{m} + fn{m} + fp{m}, 1) AS DOUBLE)) / 2, 6) AS f{m}" for m in "ab")} FROM c),
        z AS (SELECT round(fb - fa, 6) AS delta, row_number() OVER (ORDER BY round(fb - fa, 6), d) AS r FROM f)
        SELECT count(*) AS n_draws, (SELECT count(*) FROM k) AS n_groups, round(avg(delta), 6) AS mean_delta, max(delta) FILTER (r = 26) AS low, max(delta) FILTER (r = 976) AS high, round(count(*) FILTER (delta > 0) / CAST(count(*) AS DOUBLE), 4) AS new_better FROM z""",
    "j15_type_comparison": f"""WITH {_T}, y AS (SELECT s.*, heuristic_type FROM s JOIN entities e ON e.id = s.entity_id WHERE heuristic_type IS NOT NULL), {_metric('annotator_id, heuristic_type', 'y')}, mm AS (SELECT annotator_id, heuristic_type, {_SCORES} FROM k)
        SELECT o.heuristic_type, o.macro_f1 AS old_f1, w.macro_f1 AS new_f1, round(w.macro_f1 - o.macro_f1, 6) AS delta FROM mm o JOIN mm w ON o.heuristic_type = w.heuristic_type AND o.annotator_id = 'ann-03' AND w.annotator_id = 'ann-04'""",
    "p04_local_labels": f"WITH {_V} SELECT judgment_id, CAST({_LOCAL} AS BIGINT) AS label FROM v",
    "p05_offline": f"""WITH {_V}, k AS (SELECT coalesce(judge_provider, 'none') AS s, {_LOCAL} IS NOT NULL AS kept FROM v) SELECT 'offline_' || s AS corpus_source, CASE WHEN kept THEN 'offline_' || s || '_weak_or_rule' ELSE s || ':missing_local_label' END AS annotation_source, kept, count(*) AS n FROM k GROUP BY ALL""",
    "p06_train_projection": f"""WITH {_P}, c AS (SELECT pair_id, round(avg(score) FILTER (NOT isnan(score)) + 1e-9, 4) AS score FROM v GROUP BY pair_id)
        SELECT p.pair_id, CASE WHEN label = 'preserved' THEN 1 ELSE 0 END::BIGINT AS label, label AS consensus_label, c.score AS consensus_score, entity, candidate, p.entity_id, mention_id, p.text_id, t.dataset_id, row_idx, source_id, d.name AS dataset, d.split AS dataset_split, domain,
          heuristic_type AS entity_type, heuristic_group AS coarse_group, context_policy, md5(context) AS left_md5, md5(CASE WHEN strpos(lower(context), lower(entity)) > 0 AND length(entity) > 0 THEN substring(context, 1, strpos(lower(context), lower(entity)) - 1) || candidate || substring(context, strpos(lower(context), lower(entity)) + length(entity)) ELSE context END) AS right_md5
        FROM p JOIN c USING (pair_id) LEFT JOIN entities e ON e.id = p.entity_id LEFT JOIN texts t ON t.id = p.text_id LEFT JOIN datasets d ON d.id = t.dataset_id WHERE label <> 'uncertain'""",
    "p14_fallback_tags": "SELECT CAST(id AS VARCHAR) AS entity_id, CASE WHEN heuristic_group IN (" + ", ".join(f"'{x}'" for x in GROUPS) + """) THEN heuristic_group ELSE 'ambiguous' END AS coarse_group, CASE WHEN regexp_extract(observed_types_json, '"([^"]+)"\\s*:', 1) IN (""" + ", ".join(f"'{x}'" for x in FINE)
    + """) THEN regexp_extract(observed_types_json, '"([^"]+)"\\s*:', 1) ELSE 'UNKNOWN' END AS fine_type, CASE WHEN context_policy IN (""" + ", ".join(f"'{x}'" for x in POLICIES) + """) THEN context_policy ELSE 'agent_review' END AS context_policy, 0.35::DOUBLE AS confidence,
        substring('Heuristic fallback after provider/alignment failure: ' || coalesce(surface, ''), 1, 240) AS rationale FROM entities""",
    "p21_sample_weights": f"WITH {_V} SELECT judgment_id, CASE WHEN rationale IS NULL AND judge_provider IS NULL THEN 0.4 ELSE 1.0 END::DOUBLE AS weight FROM v",
    "w05_accepted": f"""WITH {_V}, b AS (SELECT mention_id, lower(candidate) AS candidate, max(score) AS score FROM v WHERE mention_id IS NOT NULL AND candidate IS NOT NULL AND lower(candidate) <> lower(entity) AND NOT isnan(score) GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY mention_id ORDER BY score DESC, candidate) AS rank FROM b) SELECT mention_id, candidate, score, rank FROM r WHERE rank <= 3""",
    "n09_log_probabilities": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: -abs(CAST(x AS DOUBLE))) AS p FROM embeddings), m AS (SELECT *, list_sum(p) / len(p) AS mean, list_sum(p[1:len(p) // 2]) / (len(p) // 2) AS first FROM e)
        SELECT vec_id, round(mean, 6) AS avg, round(list_sum(p), 6) AS sum, round(list_min(p), 6) AS min, round(mean - first, 6) AS delta, round(exp(mean), 6) AS probability FROM m""",
    "n10_softmax": """WITH e AS (SELECT vec_id, list_transform(embedding[1:3], lambda x: exp(8 * CAST(x AS DOUBLE))) AS x FROM embeddings), s AS (SELECT vec_id, list_transform(x, lambda v: v / list_sum(x)) AS s FROM e)
        SELECT vec_id, CAST(list_position(s, list_max(s)) - 1 AS BIGINT) AS head, round(list_max(s), 6) AS probability FROM s""",
    "a30_checkpoint": f"""WITH {_T}, {_D.replace("d AS (", "dd AS (", 1)}, {_metric('annotator_id', 's')}, mm AS (SELECT annotator_id, {_SCORES} FROM k), h AS (SELECT annotator_id, count(*) AS n, avg(CASE WHEN relation = derived THEN 1.0 ELSE 0.0 END) AS share FROM (SELECT DISTINCT judgment_id, pair_id, annotator_id, a_to_b, b_to_a, relation, confidence, derived, label FROM dd) GROUP BY annotator_id),
        r AS (SELECT mm.annotator_id, round(macro_f1 + 0.2 * coalesce(CASE WHEN n >= 20 THEN share END, 0.0), 6) AS score FROM mm LEFT JOIN h USING (annotator_id)) SELECT *, row_number() OVER (ORDER BY score DESC, annotator_id) = 1 AS best FROM r""",
    "l03_seeded_sample": "SELECT doc_id FROM (SELECT DISTINCT doc_id FROM documents) ORDER BY sha1('29|' || doc_id), doc_id LIMIT 50",
    "m07_unordered_pairs": "SELECT least(lower(entity), lower(candidate)) AS a, greatest(lower(entity), lower(candidate)) AS b, count(DISTINCT pair_id) AS n FROM judgments WHERE entity IS NOT NULL AND candidate IS NOT NULL GROUP BY 1, 2",
    "j08_lexicon_topk": f"WITH {_COS.replace('FROM embeddings),', 'FROM embeddings WHERE label < 5),')}, t AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, id) AS rank, cosine FROM c) SELECT * FROM t WHERE rank <= 3",
    "j05_overlay_by_text": f"""WITH {_V}, {_D}, n AS (SELECT pair_id, min(entity) AS entity, min(candidate) AS candidate FROM v GROUP BY pair_id), k AS (SELECT pair_id, {_KEY.format(x='entity')} || chr(31) || {_KEY.format(x='candidate')} AS key FROM n),
        o AS (SELECT key, min(a_to_b) AS a_to_b, min(b_to_a) AS b_to_a FROM d JOIN k USING (pair_id) WHERE a_to_b IS NOT NULL AND b_to_a IS NOT NULL GROUP BY key HAVING count(DISTINCT a_to_b || '|' || b_to_a) = 1) SELECT pair_id, a_to_b, b_to_a FROM k JOIN o USING (key)""",
}
