"""Queries of contexts: the mention that is meant, windows and budgets around it."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contexts as K
from ..operators.skew import spread_join
from ..sources.tables import table


def _facts(spark, folder):
    """One row per mention with its surface, context and masked text."""
    m = table(spark, folder, "mentions").groupBy("id").agg(*[F.min(c).alias(c) for c in ("entity_id", "text_id", "mask_idx", "full_context")])
    e = table(spark, folder, "entities").select(F.col("id").alias("entity_id"), "surface")
    t = table(spark, folder, "texts").select(F.col("id").alias("text_id"), "masked_text")
    return spread_join(m, e, "entity_id").join(t, "text_id")


def _sides(spark, folder):
    """Left and right sides of judged pairs in the five forms that rows come in, by the remainder of the pair's number."""
    j = table(spark, folder, "judgments").groupBy("pair_id").agg(*[F.min(c).alias(c) for c in ("mention_id", "entity", "candidate")])
    f = _facts(spark, folder).withColumnRenamed("id", "mention_id")
    rows = j.join(f, "mention_id").where("masked_text IS NOT NULL")
    form = F.pmod(F.regexp_extract("pair_id", "([0-9]+)$", 1).cast("long"), F.lit(5))
    filled = T.replace_nth_mask(F.col("masked_text"), F.col("mask_idx"), F.col("candidate"))
    c = F.regexp_replace("full_context", T.MASK, "_")
    changed = T.replace_first(c, F.col("entity"), F.col("candidate"))
    left = F.when(form <= 1, F.col("masked_text")).when(form == 2, c).when(form == 3, F.concat(c, F.lit(" end"))).otherwise(F.upper("entity"))
    right = F.when(form == 0, filled).when(form == 1, F.concat(filled, F.lit(" end"))).when(form == 2, changed).when(form == 3, changed).otherwise(F.lit("nothing"))
    return rows.select("pair_id", "entity", "candidate", "mask_idx", left.alias("left"), right.alias("right"))


def t13_materialized(spark, folder):
    x = K.materialized(*[F.col(c) for c in ("left", "right", "entity", "candidate", "mask_idx")])
    rows = _sides(spark, folder).select("pair_id", x.alias("x"))
    return rows.select("pair_id", "x.how", F.md5("x.left").alias("left_md5"), F.md5("x.right").alias("right_md5"))


def t12_matching_occurrence(spark, folder):
    rows = _sides(spark, folder)
    found = T.matching_occurrence(F.col("right"), F.col("candidate"), F.col("entity"), F.col("left"))
    return rows.select("pair_id", F.md5(found).alias("md5")).where("md5 IS NOT NULL")


def t15_centred_window(spark, folder):
    return _facts(spark, folder).select("id", F.md5(T.window_around(F.col("full_context"), F.col("surface"), F.lit(80))).alias("md5")).where("md5 IS NOT NULL")


def t18_marked_crop(spark, folder):
    c = T.crop(F.col("full_context"), F.col("surface"), 60)
    return _facts(spark, folder).select("id", F.md5(T.mark_first(c, F.col("surface"))).alias("md5")).where("md5 IS NOT NULL")


def t19_target_marker(spark, folder):
    """Masked texts rebuilt for one mention: the others filled, the target marked."""
    f = _facts(spark, folder).where("masked_text IS NOT NULL AND mask_idx IS NOT NULL")
    filled = f.groupBy("text_id", "mask_idx").agg(F.min("surface").alias("surface"), F.min("id").alias("id"), F.min("masked_text").alias("masked_text"))
    per = filled.groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct("mask_idx", "surface"))).alias("values"), F.min_by("id", "mask_idx").alias("id"), F.min("mask_idx").alias("target"), F.min("masked_text").alias("masked_text"))
    return per.select("text_id", "id", F.md5(K.target_marked(F.col("masked_text"), F.col("values"), F.col("target"))).alias("md5"))


def t20_crop_span(spark, folder):
    at = F.position(F.lower("surface"), F.lower("full_context")) - 1
    x = T.crop_span(F.col("full_context"), at, at + F.length("surface"), 30)
    rows = _facts(spark, folder).where((at >= 0) & (F.length("surface") > 0)).select("id", x.alias("x"))
    return rows.select("id", F.md5("x.text").alias("md5"), F.col("x.begin").cast("long").alias("begin"), F.col("x.end").cast("long").alias("end"))


def t23_token_budget(spark, folder):
    x = T.token_budget(F.col("full_context"), F.col("surface"), F.lit(16))
    return _facts(spark, folder).where("full_context IS NOT NULL").select("id", F.md5(x).alias("md5"))


def t31_clipped(spark, folder):
    d = table(spark, folder, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.md5(T.clip(F.col("text"), 240)).alias("md5"))


def t33_pair_budget(spark, folder):
    x = K.pair_budget(F.col("full_context"), T.replace_first(F.col("full_context"), F.col("surface"), F.lit("the other one")), F.col("surface"), F.lit("the other one"), 24)
    rows = _facts(spark, folder).where("full_context IS NOT NULL").select("id", x.alias("x"))
    return rows.select("id", F.md5("x.left").alias("left_md5"), F.md5("x.right").alias("right_md5"))


def p15_views(spark, folder):
    v = K.views(F.col("left"), F.col("right"), F.col("entity"), F.col("candidate"))
    rows = _sides(spark, folder).select("pair_id", F.inline(v))
    return rows.select("pair_id", "mode", F.md5("first").alias("first_md5"), F.md5("second").alias("second_md5"))


def a09_model_inputs(spark, folder):
    """Judgments with the same sides and names count once; those with contradictory labels not at all."""
    from ..operators import cleaning as C
    from ..operators import judging as J

    v = J.votes(table(spark, folder, "judgments")).where("label IN ('preserved', 'changed')").select("pair_id", "judgment_id", "label")
    rows = _sides(spark, folder).join(v, "pair_id")
    keys = {c: F.md5(T.folded_space(F.col(c))) for c in ("left", "right", "entity", "candidate")}
    found = C.resolved(rows.select(*[k.alias(c) for c, k in keys.items()], "label", "judgment_id"), list(keys), "label", ["judgment_id"])
    return found.groupBy("status").agg(F.count("*").alias("n_inputs"), F.sum("n_rows").alias("n_rows"))


QUERIES = {k: f for k, f in globals().items() if callable(f) and k[0] in "tpa" and k[1:3].isdigit()}

from .judging import _V  # noqa: E402

_M = r"(?i)[<\[](?:ent_)?mask[>\]]"
_NORM = r"trim(regexp_replace({x}, '[\s\x{{00A0}}]+', ' ', 'g'))"
_KEY = "lower(" + _NORM + ")"
_FACTS = """m AS (SELECT id, min(entity_id) AS entity_id, min(text_id) AS text_id, min(mask_idx) AS mask_idx, min(full_context) AS full_context FROM mentions GROUP BY id),
        f AS (SELECT m.*, surface, masked_text FROM m JOIN entities e ON e.id = m.entity_id JOIN texts t ON t.id = m.text_id)"""


def _first(x, needle, value):
    at = f"strpos(lower({x}), lower({needle}))"
    return f"CASE WHEN {at} > 0 AND length({needle}) > 0 THEN substring({x}, 1, {at} - 1) || {value} || substring({x}, {at} + length({needle})) ELSE {x} END"


def _nth_mask(x, n, value):
    """The parts of a text around its masks put together again, the n-th mask replaced."""
    parts, found = f"string_split_regex({x}, '{_M}')", f"regexp_extract_all({x}, '{_M}')"
    return f"array_to_string(list_transform({parts}, lambda p, i: p || coalesce(CASE WHEN i - 1 = {n} AND i <= len({found}) THEN {value} ELSE ({found})[i] END, '')), '')"


def _matching(x, needle, value, target):
    parts = f"string_split({x}, {needle})"
    filled = f"array_to_string(list_transform({parts}, lambda p, k: p || CASE WHEN k = n THEN {value} WHEN k < len({parts}) THEN {needle} ELSE '' END), '')"
    return f"CASE WHEN {needle} <> '' THEN list_filter(list_transform(range(1, len({parts})), lambda n: {filled}), lambda y: {_KEY.format(x='y')} = {_KEY.format(x=target)})[1] END"


_SIDES = rf"""{_FACTS}, j AS (SELECT pair_id, min(mention_id) AS mention_id, min(entity) AS entity, min(candidate) AS candidate FROM judgments GROUP BY pair_id),
        a AS (SELECT pair_id, entity, candidate, mask_idx, masked_text, regexp_replace(full_context, '{_M}', '_', 'g') AS c, CAST(regexp_extract(pair_id, '([0-9]+)$', 1) AS BIGINT) % 5 AS form FROM j JOIN f ON f.id = j.mention_id WHERE masked_text IS NOT NULL),
        b AS (SELECT *, {_nth_mask('masked_text', 'mask_idx', 'candidate')} AS filled, {_first('c', 'entity', 'candidate')} AS changed FROM a),
        s AS (SELECT pair_id, entity, candidate, mask_idx, CASE WHEN form <= 1 THEN masked_text WHEN form = 2 THEN c WHEN form = 3 THEN c || ' end' ELSE upper(entity) END AS "left",
          CASE form WHEN 0 THEN filled WHEN 1 THEN filled || ' end' WHEN 2 THEN changed WHEN 3 THEN changed ELSE 'nothing' END AS "right" FROM b)"""
_COUNT = f"len(regexp_extract_all(l, '{_M}'))"
_MARKED = """k AS (SELECT *, strpos(lower(x), lower(n)) AS pos FROM g), q AS (SELECT *, pos > 0 AND length(n) > 0 AS hit FROM k),
        r AS (SELECT *, list_filter(regexp_split_to_array(substring(x, 1, pos - 1), '\\s+'), lambda w: w <> '') AS a, CASE WHEN hit THEN list_filter(regexp_split_to_array('[' || substring(x, pos, length(n)) || ']', '\\s+'), lambda w: w <> '') END AS b,
          list_filter(regexp_split_to_array(substring(x, pos + length(n)), '\\s+'), lambda w: w <> '') AS c, list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '') AS w FROM q),
        u AS (SELECT *, budget - len(b) AS room FROM r), v AS (SELECT *, least(len(a), greatest(CAST(floor(room / 2) AS BIGINT), room - len(c))) AS before FROM u),
        o AS (SELECT id, CASE WHEN hit AND room >= 0 THEN array_to_string(list_concat(CASE WHEN before > 0 THEN a[len(a) - before + 1:len(a)] ELSE [] END, b, c[1:least(len(c), room - before)]), ' ') ELSE array_to_string(w[1:budget], ' ') END AS t FROM v)"""



def _tagged(x, needle, start, end):
    pos = f"strpos(lower({x}), lower({needle}))"
    return f"CASE WHEN {pos} > 0 AND length({needle}) > 0 THEN substring({x}, 1, {pos} - 1) || '{start} ' || substring({x}, {pos}, length({needle})) || ' {end}' || substring({x}, {pos} + length({needle})) ELSE {x} END"


_NAMES = "'Original entity: ' || coalesce(e, '') || chr(10) || 'Candidate entity: ' || coalesce(c, '')"

SQL = {
    "p15_views": f"""WITH {_SIDES}, w AS (SELECT pair_id, "left" AS l, "right" AS r, entity AS e, candidate AS c FROM s), u AS (
          SELECT pair_id, 'pair' AS mode, l AS x, r AS y FROM w UNION ALL SELECT pair_id, 'marked_pair', {_tagged('l', 'e', '[E1]', '[/E1]')}, {_tagged('r', 'c', '[E2]', '[/E2]')} FROM w
          UNION ALL SELECT pair_id, 'entity_query', l, {_NAMES} || chr(10) || '{K.QUESTION}' FROM w UNION ALL SELECT pair_id, 'masked_query', {_first('l', 'e', "'[TGT]'")}, {_NAMES} FROM w)
        SELECT pair_id, mode, md5(x) AS first_md5, md5(y) AS second_md5 FROM u""",
    "a09_model_inputs": f"""WITH {_SIDES}, {_V}, w AS (SELECT s.*, v.label FROM s JOIN v USING (pair_id) WHERE v.label IN ('preserved', 'changed')),
        g AS (SELECT {_KEY.format(x='"left"')} AS l, {_KEY.format(x='"right"')} AS r, {_KEY.format(x='entity')} AS e, {_KEY.format(x='candidate')} AS c, count(*) AS n, count(DISTINCT label) AS k FROM w GROUP BY 1, 2, 3, 4)
        SELECT CASE WHEN k = 1 THEN 'kept' ELSE 'conflict' END AS status, count(*) AS n_inputs, CAST(sum(n) AS BIGINT) AS n_rows FROM g GROUP BY 1""",
    "t13_materialized": rf"""WITH {_SIDES}, w AS (SELECT pair_id, coalesce("left", '') AS l, coalesce("right", '') AS r, coalesce(entity, '') AS e, coalesce(candidate, '') AS c, mask_idx FROM s),
        x AS (SELECT *, list_filter(range(0, {_COUNT}), lambda n: {_KEY.format(x=_nth_mask('l', 'n', 'c'))} = {_KEY.format(x='r')})[1] AS fit, {_matching('r', 'c', 'e', 'l')} AS by_c, {_matching('l', 'e', 'c', 'r')} AS by_e FROM w),
        y AS (SELECT *, CASE WHEN {_COUNT} > 0 AND c <> '' AND fit IS NOT NULL THEN 'mask_diff:' || fit WHEN {_COUNT} > 0 AND c <> '' AND mask_idx >= 0 AND mask_idx < {_COUNT} THEN 'mask_idx_fallback:' || mask_idx
          WHEN e <> '' AND c <> '' AND by_c IS NOT NULL THEN 'candidate_diff' WHEN e <> '' AND c <> '' AND by_e IS NOT NULL THEN 'entity_diff' WHEN e <> '' AND c <> '' AND strpos(lower(r), lower(c)) > 0 THEN 'candidate_reverse_replace' ELSE 'unresolved' END AS how FROM x)
        SELECT pair_id, how, md5(CASE WHEN how LIKE 'mask_diff%' THEN {_nth_mask('l', 'fit', 'e')} WHEN how LIKE 'mask_idx%' THEN {_nth_mask('l', 'mask_idx', 'e')} WHEN how = 'candidate_diff' THEN by_c WHEN how = 'candidate_reverse_replace' THEN {_first('r', 'c', 'e')} ELSE l END) AS left_md5,
          md5(CASE WHEN how = 'entity_diff' THEN by_e ELSE r END) AS right_md5 FROM y""",
    "t12_matching_occurrence": f"""WITH {_SIDES}, w AS (SELECT pair_id, "left" AS l, "right" AS r, entity AS e, candidate AS c FROM s) SELECT pair_id, md5({_matching('r', 'c', 'e', 'l')}) AS md5 FROM w WHERE {_matching('r', 'c', 'e', 'l')} IS NOT NULL""",
    "t15_centred_window": f"""WITH {_FACTS}, k AS (SELECT id, full_context AS x, strpos(lower(full_context), lower(surface)) AS pos, length(surface) AS n FROM f WHERE full_context IS NOT NULL)
        SELECT id, md5(CASE WHEN pos > 0 THEN substring(x, greatest(1, least(pos + n // 2 - 40, length(x) - 79)), 80) ELSE substring(x, 1, 80) END) AS md5 FROM k""",
    "t18_marked_crop": f"""WITH {_FACTS}, k AS (SELECT id, surface AS n, full_context AS x, strpos(lower(full_context), lower(surface)) AS pos FROM f WHERE full_context IS NOT NULL),
        c AS (SELECT id, n, trim(CASE WHEN pos > 0 THEN substring(x, greatest(1, pos - 60), pos + length(n) + 60 - greatest(1, pos - 60)) ELSE substring(x, 1, 120) END, ' ') AS x FROM k)
        SELECT id, md5(CASE WHEN strpos(lower(x), lower(n)) > 0 AND length(n) > 0 THEN substring(x, 1, strpos(lower(x), lower(n)) - 1) || '[' || substring(x, strpos(lower(x), lower(n)), length(n)) || ']' || substring(x, strpos(lower(x), lower(n)) + length(n)) ELSE x END) AS md5 FROM c""",
    "t19_target_marker": f"""WITH {_FACTS}, k AS (SELECT text_id, mask_idx, min(surface) AS surface, min(id) AS id, min(masked_text) AS x FROM f WHERE masked_text IS NOT NULL AND mask_idx IS NOT NULL GROUP BY text_id, mask_idx),
        p AS (SELECT text_id, min_by(id, mask_idx) AS id, min(mask_idx) AS target, min(x) AS x, map_from_entries(list(struct_pack(k := mask_idx, v := surface))) AS v FROM k GROUP BY text_id)
        SELECT text_id, id, md5(array_to_string(list_transform(string_split_regex(x, '{_M}'), lambda p, i: p || coalesce(CASE WHEN i <= len(regexp_extract_all(x, '{_M}')) THEN CASE WHEN i - 1 = target THEN '[TARGET]' ELSE v[i - 1] END END, regexp_extract_all(x, '{_M}')[i], '')), '')) AS md5 FROM p""",
    "t20_crop_span": f"""WITH {_FACTS}, k AS (SELECT id, full_context AS x, strpos(lower(full_context), lower(surface)) - 1 AS pos, length(surface) AS n FROM f WHERE length(surface) > 0), c AS (SELECT *, greatest(0, pos - 30) AS low FROM k WHERE pos >= 0)
        SELECT id, md5(substring(x, low + 1, pos + n + 30 - low)) AS md5, pos - low AS "begin", pos + n - low AS "end" FROM c""",
    "t23_token_budget": f"WITH {_FACTS}, g AS (SELECT id, full_context AS x, surface AS n, 16 AS budget FROM f WHERE full_context IS NOT NULL), {_MARKED} SELECT id, md5(t) AS md5 FROM o",
    "t31_clipped": "SELECT doc_id, md5(substring(text, 1, 240)) AS md5 FROM documents WHERE text IS NOT NULL",
    "t33_pair_budget": f"""WITH {_FACTS}, one AS (WITH g AS (SELECT id, full_context AS x, surface AS n, 12 AS budget FROM f WHERE full_context IS NOT NULL), {_MARKED} SELECT * FROM o),
        two AS (WITH g AS (SELECT id, {_first('full_context', 'surface', "'the other one'")} AS x, 'the other one' AS n, 24 - len(regexp_split_to_array(trim(one.t), '\\s+')) AS budget FROM f JOIN one USING (id)), {_MARKED} SELECT * FROM o)
        SELECT id, md5(one.t) AS left_md5, md5(two.t) AS right_md5 FROM one JOIN two USING (id)""",
}
