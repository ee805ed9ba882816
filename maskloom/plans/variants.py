"""Queries of changed and equivalent values, aliases and month steps."""

from pyspark.sql import functions as F

from ..functions import aliases as A
from ..functions import text as T
from ..functions import variants as V
from ..sources.tables import table


def _numeric(spark, folder):
    return table(spark, folder, "entities").where("heuristic_group = 'numeric'")


def n01_perturb(spark, folder):
    return _numeric(spark, folder).select("id", F.array_join(V.perturbed(F.col("surface")), "|").alias("variants"))


def n02_perturb_wide(spark, folder):
    found = V.perturbed(F.col("surface"), (1500, 2200), V.MORE_SWAPS, every_swap=True)
    return table(spark, folder, "entities").select("id", F.array_join(found, "|").alias("variants")).where("variants <> ''")


def n04_equivalent(spark, folder):
    return _numeric(spark, folder).select("id", F.array_join(V.equivalents(F.col("surface"), F.col("heuristic_type")), "|").alias("variants"))


def n05_changed(spark, folder):
    return _numeric(spark, folder).select("id", F.array_join(V.changed(F.col("surface"), F.col("heuristic_type")), "|").alias("variants"))


def n05_number_words(spark, folder):
    rows = table(spark, folder, "mentions").select("id", T.clip(F.col("short_context"), 1_000_000).alias("x")).distinct()
    return rows.where(~F.col("x").rlike(r"\d")).select("id", F.get(V.changed(F.col("x"), F.lit("CARDINAL")), F.lit(0)).alias("variant")).where("variant IS NOT NULL")


def s12_alias_index(spark, folder):
    return A.index(A.resource(spark)).select("key", F.array_join("strict", "|").alias("strict"), F.array_join("review", "|").alias("review"))


def j03_alias_candidates(spark, folder):
    """Aliases of entities and of the resource's own names."""
    e = table(spark, folder, "entities").select("surface")
    own = A.resource(spark).select(F.explode(F.concat("strict", "review", F.array("canonical"))).alias("surface"))
    rows = A.alias_candidates(e.unionByName(own).distinct(), F.col("surface"), A.index(A.resource(spark)))
    return rows.where("size(strict) > 0 OR size(review) > 0").select("surface", F.array_join("strict", "|").alias("strict"), F.array_join("review", "|").alias("review"))


QUERIES = {k: f for k, f in globals().items() if callable(f) and k[0] in "njs" and k[1:3].isdigit()}

_NORM = r"trim(regexp_replace({x}, '[\s\x{{00A0}}]+', ' ', 'g'))"
_KEY = r"regexp_replace(lower(" + _NORM + r"), '[^\p{{L}}\p{{N}}_%$£€]+', '', 'g')"
_DISTINCT = "array_to_string(list_filter(l, lambda x, i: x IS NOT NULL AND x <> s AND list_position(l, x) = i), '|')"
_WHOLE = "CASE WHEN contains(raw, ',') THEN format('{{:,}}', CAST({x} AS BIGINT)) ELSE CAST(CAST({x} AS BIGINT) AS VARCHAR) END"
_PUT = "substring(s, 1, strpos(s, raw) - 1) || {x} || substring(s, strpos(s, raw) + length(raw))"
_DEC = "DECIMAL(28, 6)"


def _numbers(pattern, source):
    return rf"""b AS (SELECT id, heuristic_type AS t, {_NORM.format(x='surface')} AS s FROM {source}),
        r AS (SELECT *, nullif(regexp_extract(s, '{pattern}'), '') AS raw FROM b),
        v AS (SELECT *, TRY_CAST(replace(raw, ',', '') AS {_DEC}) AS n, contains(raw, '.') AS p FROM r)"""


def _swap(a, b):
    return f"CASE WHEN contains(s, '{a}') THEN substring(s, 1, strpos(s, '{a}') - 1) || '{b}' || substring(s, strpos(s, '{a}') + {len(a)}) END"


def _perturb(source, low, high, swaps, every):
    swapped = ", ".join(_swap(a, b) for a, b in swaps.items())
    return rf"""WITH {_numbers(V.SIGNED, source)},
        k AS (SELECT *, n = floor(n) AND regexp_matches(s, '{V.MONTH_DAY}\Q' || raw || '\E\b') AS day, CAST(CASE WHEN p THEN greatest(1, abs(n) * 0.1) ELSE greatest(1, round_even(CAST(abs(n) AS DOUBLE) * 0.1, 0)) END AS {_DEC}) AS step FROM v),
        o AS (SELECT *, CAST(CASE WHEN n IS NULL THEN [] WHEN day THEN [greatest(1, n - 1), least(28, n + 1)] WHEN n = 0 THEN [1, 10] WHEN n BETWEEN {low} AND {high} AND n = floor(n) THEN [n - 1, n + 1] ELSE [n + step, greatest(0, n - step)] END AS {_DEC}[]) AS o FROM k),
        w AS (SELECT id, s, list_concat(list_transform(o, lambda x: {_PUT.format(x="CASE WHEN NOT p OR x = floor(x) THEN " + _WHOLE.format(x="x") + " ELSE CAST(CAST(x AS DECIMAL(28, 2)) AS VARCHAR) END")}),
          {f"[{swapped}]" if every else f"[coalesce({swapped})]"}) AS l FROM o), z AS (SELECT id, {_DISTINCT} AS variants FROM w)"""


_WORDS = "CASE " + " ".join(rf"WHEN regexp_matches(lower(s), '\b{a}\b') THEN regexp_replace(s, '(?i)^(.*?)\b{a}\b', '\1{b}')" for a, b in V.NEIGHBOURS.items()) + " END"
_PLACES = "CASE length(split_part(raw, '.', 2)) " + " ".join(f"WHEN {k} THEN CAST(CAST(x AS DECIMAL(28, {k})) AS VARCHAR)" for k in (1, 2, 3, 4)) + " ELSE CAST(x AS VARCHAR) END"
_CHANGED = rf"""WITH {_numbers(V.GROUPED, '{source}')},
        k AS (SELECT *, CAST(greatest(1, round_even(CAST(abs(n) AS DOUBLE) * 0.1, 2)) AS {_DEC}) AS step FROM v),
        o AS (SELECT *, CAST(CASE WHEN n IS NULL THEN [] WHEN t = 'DATE' AND n = floor(n) AND n BETWEEN 1500 AND 2200 THEN [n - 1, n + 1] WHEN t = 'DATE' AND n = floor(n) AND n BETWEEN 1 AND 31 THEN [greatest(1, n - 1), least(31, n + 1)]
          WHEN t IN ('PERCENT', 'ORDINAL') THEN [greatest(0, n - 1), n + 1] WHEN n = 0 THEN [1, 2] ELSE [greatest(0, n - step), n + step] END AS {_DEC}[]) AS o FROM k),
        w AS (SELECT id, s, list_concat(list_transform(o, lambda x: {_PUT.format(x="CASE WHEN p THEN " + _PLACES + " ELSE " + _WHOLE.format(x="round_even(CAST(x AS DOUBLE), 0)") + " END")}),
          [CASE WHEN n IS NULL THEN {_WORDS} END, {", ".join(f"CASE WHEN t = 'MONEY' THEN {_swap(a, b)} END" for a, b in V.SWAPS.items())}]) AS l FROM o), z AS (SELECT id, {_DISTINCT} AS variants FROM w)"""
_MONTHS = ", ".join(
    rf"""CASE WHEN t = 'DATE' THEN CASE WHEN regexp_matches(lower(s), '\b{a.lower()}\b') THEN regexp_replace(s, '(?i)^(.*?)\b{a}\b', '\1{b}')
            WHEN regexp_matches(lower(s), '\b{b.rstrip(".").lower()}') THEN regexp_replace(s, '(?i)^(.*?)\b{b.rstrip(".")}\.?', '\1{a}') END END"""
    for a, b in V.SHORT_MONTHS.items()
)
_CURRENCY = ", ".join(f"CASE WHEN t = 'MONEY' AND contains(s, '{a}') THEN trim({_swap(a, '')}) || '{b}' END" for a, b in V.CURRENCY_WORDS.items())
_ALIASES = "a(place, canonical, strict, review) AS (VALUES " + ", ".join(
    f"({i}, '{c}', [{', '.join(repr(x) for x in s)}]::VARCHAR[], [{', '.join(repr(x) for x in r)}]::VARCHAR[])" for i, (c, s, r) in enumerate(A.ALIASES)
) + ")"
_INDEX = f"""{_ALIASES}, y AS (SELECT place, strict, review, unnest(list_concat(strict, review, [canonical])) AS name FROM a),
        i AS (SELECT {_KEY.format(x='name')} AS key, max_by(strict, place) AS strict, max_by(review, place) AS review FROM y GROUP BY 1)"""


def _kept(c):
    return f"list_filter({c}, lambda x: {_KEY.format(x='x')} <> i.key)"



NUMERIC = "(SELECT * FROM entities WHERE heuristic_group = 'numeric')"
EQUIVALENT = rf"""WITH b AS (SELECT id, heuristic_type AS t, {_NORM.format(x='surface')} AS s FROM {{source}}),
        w AS (SELECT id, s, list_transform([CASE WHEN regexp_matches(s, '\d,\d') THEN regexp_replace(regexp_replace(s, '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g') END,
          CASE WHEN regexp_matches(s, '\b\d+\.0\b') THEN regexp_replace(s, '\b(\d+)\.0\b', '\1', 'g') END, CASE WHEN t = 'PERCENT' AND contains(s, '%') THEN replace(s, '%', ' percent') END,
          CASE WHEN t = 'PERCENT' THEN CASE WHEN contains(s, '%') THEN replace(s, '%', ' per cent') WHEN regexp_matches(lower(s), '\bpercent\b') THEN regexp_replace(s, '(?i)\s*percent\b', '%', 'g') WHEN regexp_matches(lower(s), '\bper cent\b') THEN regexp_replace(s, '(?i)\s*per cent\b', '%', 'g') END END,
          {_CURRENCY}, {_MONTHS}], lambda x: {_NORM.format(x='x')}) AS l FROM b), z AS (SELECT id, {_DISTINCT} AS variants FROM w)"""
PERTURBED = _perturb("{source}", 1900, 2100, V.SWAPS, False)
CHANGED = _CHANGED

SQL = {
    "n01_perturb": PERTURBED.replace("{source}", NUMERIC) + " SELECT * FROM z",
    "n02_perturb_wide": _perturb("entities", 1500, 2200, V.MORE_SWAPS, True) + " SELECT * FROM z WHERE variants <> ''",
    "n04_equivalent": EQUIVALENT.replace("{source}", NUMERIC) + " SELECT * FROM z",
    "n05_changed": CHANGED.replace("{source}", NUMERIC) + " SELECT * FROM z",
    "n05_number_words": rf"""WITH b AS (SELECT DISTINCT id, {_NORM.format(x='short_context')} AS s FROM mentions WHERE NOT regexp_matches(short_context, '\d')) SELECT id, {_WORDS} AS variant FROM b WHERE variant IS NOT NULL""",
    "s12_alias_index": f"WITH {_INDEX} SELECT key, array_to_string(strict, '|') AS strict, array_to_string(review, '|') AS review FROM i",
    "j03_alias_candidates": f"""WITH {_INDEX}, r AS (SELECT surface FROM entities UNION SELECT unnest(list_concat(strict, review, [canonical])) FROM a),
        k AS (SELECT surface, {_kept('strict')} AS strict, {_kept('review')} AS review FROM r JOIN i ON i.key = {_KEY.format(x='surface')})
        SELECT surface, array_to_string(strict, '|') AS strict, array_to_string(review, '|') AS review FROM k WHERE len(strict) + len(review) > 0""",
}
