"""Generator queries."""

from pyspark.sql import functions as F

from ..operators import generate as G
from ..sources.tables import table


def _em(spark, folder):
    return table(spark, folder, "entities"), table(spark, folder, "mentions")


def g02_augment(spark, folder):
    e, m = _em(spark, folder)
    return G.rule_pairs(m, e).groupBy("pair_kind", F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))


def g07_numeric(spark, folder):
    e, m = _em(spark, folder)
    return G.numeric_pairs(e, m)


def g08_proper_pool(spark, folder):
    return G.proper_pool(table(spark, folder, "entities"))


def j13_synonyms(spark, folder):
    return G.synonyms(table(spark, folder, "entities"), "surface", spark)


def j12_shared_sense(spark, folder):
    pairs = table(spark, folder, "judgments").select(F.lower("entity").alias("word"), F.lower("candidate").alias("candidate")).distinct()
    return pairs.join(G.synonyms(pairs, "word", spark), ["word", "candidate"], "left_semi")


def f07_clean_surfaces(spark, folder):
    e = table(spark, folder, "entities")
    return e.groupBy("heuristic_group").agg(F.count("*").alias("n"), F.count_if(G.clean_surface(F.col("surface"))).alias("n_clean"))


def f14_morphology(spark, folder):
    e = table(spark, folder, "entities").where("heuristic_group IN ('common_entity', 'domain_term')")
    return e.select("id", G.morphology_key(F.col("surface")).alias("key"))


def f07_strict_surfaces(spark, folder):
    e = table(spark, folder, "entities").where("surface IS NOT NULL")
    return e.select("id", G.strict_surface(F.col("surface")).alias("strict"))


def f13_inflections(spark, folder):
    """Judged pairs of words and plurals, with each surface and its plural beside them."""
    e = table(spark, folder, "entities").where("surface IS NOT NULL").select(F.col("surface").alias("entity"), F.concat("surface", F.lit("s")).alias("candidate"))
    j = table(spark, folder, "judgments").select("entity", "candidate").where("entity IS NOT NULL AND candidate IS NOT NULL")
    rows = e.unionByName(j).distinct()
    return rows.select("entity", "candidate", G.simple_inflection(F.col("entity"), F.col("candidate")).alias("inflection"))


def j19_sampled_pool(spark, folder):
    return G.sampled_pool(table(spark, folder, "entities"))


QUERIES = {k: f for k, f in globals().items() if callable(f) and k[0] in "gjf" and k[1:3].isdigit()}

from .inventory import SQL as _I  # noqa: E402
from . import variants as _X  # noqa: E402
from ..functions import rules as _R  # noqa: E402
from .quality import SQL as _Q  # noqa: E402

_TYPED = "(SELECT * FROM entities WHERE heuristic_group = 'numeric' AND heuristic_type IN (" + ", ".join(f"'{t}'" for t in G.NUMERIC_TYPES) + "))"
_MONTH = "CASE " + " ".join(f"WHEN contains(lower(surface), '{a}') THEN regexp_replace(surface, '(?i){a}', '{b.capitalize()}', 'g')" for a, b in zip(_R.MONTHS, _R.MONTHS[1:] + _R.MONTHS[:1])) + " END"

_LEX = "lex(word, sense) AS (VALUES " + ", ".join(f"('{w}', '{s}')" for s, ws in G.SENSES.items() for w in ws.split()) + ")"
_SYN = "SELECT a.word, b.word AS candidate, count(DISTINCT a.sense) AS n_senses FROM w JOIN lex a ON a.word = w.word JOIN lex b ON b.sense = a.sense AND b.word <> a.word GROUP BY ALL"
_KEY = r"regexp_replace(lower(trim(regexp_replace({x}, '[\s\x{{00A0}}]+', ' ', 'g'))), '[^\p{{L}}\p{{N}}_%$£€]+', '', 'g')"
_MORPH = "CASE " + " ".join(
    f"WHEN ends_with(lower(surface), '{s}') AND length(surface) > {len(s) + 2} THEN substring(lower(surface), 1, length(surface) - {len(s)}) || '{p}'" for s, p in G.PLURALS.items()
) + " ELSE lower(surface) END"
_TEMPORAL = "['" + "','".join("january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday today yesterday tomorrow week year".split()) + "']"

_POOL = r"""WITH e AS (SELECT id, heuristic_type AS t, list_distinct(regexp_extract_all(lower(surface), '[\p{L}\p{N}]+')) AS w FROM entities WHERE heuristic_group = 'proper_name'),
        x AS (SELECT id, t, w, unnest(w) AS word FROM e), k AS (SELECT * FROM x),
        p AS (SELECT DISTINCT a.id AS entity_id, b.id AS candidate_id, round(len(list_intersect(a.w, b.w)) / CAST(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS DOUBLE), 6) AS score FROM k a JOIN k b ON a.t = b.t AND a.word = b.word AND a.id <> b.id),
        o AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, candidate_id) AS rank FROM p WHERE score >= 0.18) SELECT * FROM o WHERE rank <= 3"""
_SPACED = r"trim(regexp_replace({x}, '[\s\x{{00A0}}]+', ' ', 'g'))"


def _listed(words):
    return ", ".join(f"'{w}'" for w in words)


def _plural(one, many):
    stem = f"substring({one}, 1, length({one}) - 1)"
    return f"({many} = {one} || 's' OR {many} = {one} || 'es' OR (ends_with({one}, 'y') AND {many} = {stem} || 'ies') OR (ends_with({one}, 'f') AND {many} = {stem} || 'ves'))"


SQL = {
    "g02_augment": f"""WITH {_X._INDEX}, per AS (
          SELECT id AS entity_id, 0 AS o, 'positive_identity' AS k, 1 AS label, surface AS c FROM entities UNION ALL SELECT id, 1, 'positive_surface', 1, variant FROM ({_I['t24_surface_variants']})
          UNION ALL SELECT e.id, 2, 'positive_alias', 1, unnest(({_X._kept('strict')})[1:4]) FROM entities e JOIN i ON i.key = {_KEY.format(x='surface')}
          UNION ALL SELECT e.id, 3, 'context_sensitive_alias_candidate', NULL, unnest(({_X._kept('review')})[1:3]) FROM entities e JOIN i ON i.key = {_KEY.format(x='surface')}
          UNION ALL SELECT id, 4, 'negative_numeric_or_date_perturbation', 0, unnest(v[1:3]) FROM (SELECT id, list_concat(CASE WHEN coalesce(variants, '') = '' THEN [] ELSE string_split(variants, '|') END, CASE WHEN month IS NULL THEN [] ELSE [month] END) AS v
            FROM ({_X.PERTURBED.replace("{source}", "entities")} SELECT z.id, variants, {_MONTH} AS month FROM z JOIN entities USING (id)))),
        d AS (SELECT *, row_number() OVER (PARTITION BY entity_id, {_KEY.format(x='c')}, label ORDER BY o, k, c) AS r FROM per), f AS (SELECT DISTINCT id, entity_id FROM mentions)
        SELECT k AS pair_kind, CAST(label AS BIGINT) AS label, count(*) AS n FROM f JOIN d USING (entity_id) WHERE r = 1 GROUP BY ALL
        UNION ALL SELECT 'negative_same_type', 0, count(*) FROM ({_Q['j06_same_type_negative']})""",
    "g07_numeric": f"""WITH v AS (SELECT id, 'numeric_equivalent_format' AS kind, unnest((string_split(variants, '|'))[1:1]) AS candidate FROM ({_X.EQUIVALENT.replace("{source}", _TYPED)} SELECT * FROM z) WHERE variants <> ''
          UNION ALL SELECT id, 'numeric_close_changed', unnest((string_split(variants, '|'))[1:2]) FROM ({_X.CHANGED.replace("{source}", _TYPED)} SELECT * FROM z) WHERE variants <> '')
        SELECT m.id AS mention_id, candidate, kind FROM (SELECT DISTINCT id, entity_id FROM mentions) m JOIN v ON v.id = m.entity_id""",
    "g08_proper_pool": _POOL,
    "f07_strict_surfaces": f"""WITH b AS (SELECT id, {_SPACED.format(x='surface')} AS x FROM entities WHERE surface IS NOT NULL), k AS (SELECT *, regexp_extract_all(x, '[a-z]+') AS w FROM b)
        SELECT id, length(x) BETWEEN 3 AND 64 AND NOT regexp_matches(x, '\\d') AND NOT regexp_matches(lower(x), '{G.NUMBERS}') AND NOT regexp_matches(lower(x), '{G.TIMES}') AND lower(x) NOT IN ({_listed(G.GENERIC)}) AND x = lower(x) AND regexp_matches(x, '{G.SHAPE.replace("'", "''")}')
          AND len(w) > 0 AND w[1] NOT IN ({_listed(G.LEADING)}) AND NOT list_has_any(w, [{_listed([*G.UNITS, *(u + "s" for u in G.UNITS)])}]) AND NOT regexp_matches(x, '{G.POLAR}') AS strict FROM k""".replace("len(w) > 0 AND w[1]", "coalesce(w[1], 'the')"),
    "f13_inflections": f"""WITH r AS (SELECT surface AS entity, surface || 's' AS candidate FROM entities WHERE surface IS NOT NULL UNION SELECT entity, candidate FROM judgments WHERE entity IS NOT NULL AND candidate IS NOT NULL),
        k AS (SELECT *, lower({_SPACED.format(x='entity')}) AS x, lower({_SPACED.format(x='candidate')}) AS y FROM r)
        SELECT entity, candidate, NOT contains(x, ' ') AND NOT contains(y, ' ') AND ({_plural('x', 'y')} OR {_plural('y', 'x')}) AS inflection FROM k""",
    "j19_sampled_pool": """WITH h AS (""" + _POOL.replace("WHERE rank <= 3", "WHERE rank <= 9") + """), o AS (SELECT entity_id, candidate_id, row_number() OVER (PARTITION BY entity_id ORDER BY sha1('19|' || entity_id || '|' || candidate_id), candidate_id) AS r FROM h)
        SELECT entity_id, candidate_id FROM o WHERE r <= 3""",
    "j13_synonyms": f"WITH {_LEX}, w AS (SELECT DISTINCT lower(surface) AS word FROM entities) {_SYN}",
    "j12_shared_sense": f"WITH {_LEX}, w AS (SELECT DISTINCT lower(entity) AS word, lower(candidate) AS candidate FROM judgments) SELECT w.* FROM w WHERE word <> candidate AND EXISTS (SELECT 1 FROM lex a JOIN lex b USING (sense) WHERE a.word = w.word AND b.word = w.candidate)",
    "f07_clean_surfaces": rf"""SELECT heuristic_group, count(*) AS n, count(*) FILTER (length(surface) BETWEEN 3 AND 64 AND NOT regexp_matches(surface, '\d') AND NOT list_has_any(regexp_extract_all(lower(surface), '[\p{{L}}\p{{N}}]+'), {_TEMPORAL})
          AND len(regexp_extract_all(lower(surface), '[\p{{L}}\p{{N}}]+')) BETWEEN 1 AND 4) AS n_clean FROM entities GROUP BY ALL""",
    "f14_morphology": f"SELECT id, {_MORPH} AS key FROM entities WHERE heuristic_group IN ('common_entity', 'domain_term')",
}
