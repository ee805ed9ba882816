"""Inventory queries."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numeric as N
from ..functions import rules as R
from ..functions import text as T
from ..operators import inventory as inv
from ..sources.tables import table

_M = r"(?i)[<\[](?:ent_)?mask[>\]]"


def m01_masks(spark, folder):
    return inv.mask_rows(table(spark, folder, "texts")).withColumn("mask_idx", F.col("mask_idx").cast("long"))


def t08_mask_counts(spark, folder):
    n = T.count_masks(F.col("masked_text")).cast("long")
    rows = table(spark, folder, "texts").select(F.col("id").alias("text_id"), n.alias("n_masks"), "mask_count")
    return rows.withColumn("differs", ~F.col("n_masks").eqNullSafe(F.col("mask_count")))


def a01_inventory(spark, folder):
    counts = inv.type_counts(table(spark, folder, "mentions"))
    named = inv.primary_type(counts).join(table(spark, folder, "entities").select(F.col("id").alias("entity_id"), "surface"), "entity_id")
    key = T.norm_key(F.col("surface"))
    return named.select("entity_id", key.alias("key"), "n_mentions", "primary_type", F.least("n_mentions", F.lit(5)).alias("n_examples"))


def a03_nested_counters(spark, folder):
    return inv.type_counts(table(spark, folder, "mentions"))


def m03_counter_merge(spark, folder):
    m = table(spark, folder, "mentions")
    early = inv.type_counts(m.where("id % 3 = 0"))
    late = inv.type_counts(m.where("id % 3 <> 0"))
    return inv.merged_counters(early, late, "entity_id", "observed_type")


def m04_json_counters(spark, folder):
    counters = F.coalesce(F.from_json("observed_types_json", "map<string,bigint>"), F.create_map().cast("map<string,bigint>"))
    return table(spark, folder, "entities").select(F.col("id").alias("entity_id"), F.explode(counters).alias("k", "n"))


def s16_json_props(spark, folder):
    k = F.try_element_at(F.from_json("props", "map<string,bigint>"), F.lit("k"))
    return table(spark, folder, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"))


def a24_group_counts(spark, folder):
    e = table(spark, folder, "entities")
    return e.groupBy("heuristic_group", "heuristic_type").agg(F.count("*").alias("n"), F.sum("mention_count").alias("mentions"))


def l02_top_entities(spark, folder):
    e = table(spark, folder, "entities").orderBy(F.desc("mention_count"), "id").limit(50)
    return e.select("id", "surface", "mention_count")


def l05_page(spark, folder):
    e = table(spark, folder, "entities").orderBy(F.desc("mention_count"), F.lower("surface"), "id").offset(40).limit(20)
    return e.select("id", "surface_key")


def k12_balanced_export(spark, folder):
    e = table(spark, folder, "entities").select("heuristic_group", "id", "surface", "mention_count")
    return inv.top_per_group(e, ["heuristic_group"], 10, F.desc("mention_count"), F.col("id")).withColumn("rank", F.col("rank").cast("long"))


def k11_slim_export(spark, folder):
    e, m, t = inv.slim_subset(*(table(spark, folder, x) for x in ("entities", "mentions", "texts")), "proper_name", 100, 3)
    rows = m.join(t.select(F.col("id").alias("text_id"), "dataset_id"), "text_id")
    return rows.groupBy("dataset_id").agg(F.count("*").alias("n_mentions"), F.count_distinct("entity_id").alias("n_entities"), F.count_distinct("text_id").alias("n_texts"))


def w03_topn_mentions(spark, folder):
    rows = table(spark, folder, "mentions").select("entity_id", "id").distinct()
    return inv.top_per_group(rows, ["entity_id"], 3, F.col("id")).withColumn("rank", F.col("rank").cast("long"))


def w07_first_delivery(spark, folder):
    rows = table(spark, folder, "mentions").select("id", "loaded_at")
    return inv.first_per_key(rows, ["id"], F.col("loaded_at"))


def w08_last_delivery(spark, folder):
    rows = table(spark, folder, "mentions").select("id", "loaded_at")
    return inv.first_per_key(rows, ["id"], F.desc("loaded_at"))


def j01_star(spark, folder):
    rows = inv.star(*(table(spark, folder, x) for x in ("mentions", "texts", "datasets"))).select("id", "entity_id", "name", "split", "domain").distinct()
    return rows.groupBy("entity_id", "name", "split", "domain").agg(F.count("*").alias("n"))


def j02_rebuild(spark, folder):
    out = inv.rebuilt_texts(*(table(spark, folder, x) for x in ("texts", "mentions", "entities")))
    return out.select("text_id", F.md5("rebuilt").alias("md5"), F.length("rebuilt").cast("long").alias("n_chars"))


def t09_nth_mask(spark, folder):
    rows = table(spark, folder, "texts").where("masked_text IS NOT NULL")
    return rows.select(F.col("id").alias("text_id"), F.md5(T.replace_nth_mask(F.col("masked_text"), F.lit(1), F.lit("THIS"))).alias("md5"))


def t14_crop(spark, folder):
    m = table(spark, folder, "mentions").select("id", "entity_id", "full_context").distinct()
    e = table(spark, folder, "entities").select(F.col("id").alias("entity_id"), "surface")
    return m.join(e, "entity_id").select("id", T.crop(F.col("full_context"), F.col("surface"), 40).alias("context"))


def t17_short_window(spark, folder):
    return table(spark, folder, "texts").select(F.col("id").alias("text_id"), T.window_words(F.col("masked_text"), 2).alias("context"))


def t02_keys(spark, folder):
    s = F.col("surface")
    return table(spark, folder, "entities").select("id", T.norm_key(s).alias("norm_key"), T.compact(s).alias("compact"), T.article_free(s).alias("article_free"), T.normalize_space(s).alias("spaced"))


def t24_surface_variants(spark, folder):
    e = table(spark, folder, "entities")
    return e.select("id", F.explode(T.surface_variants(F.col("surface"))).alias("variant"))


def t25_types(spark, folder):
    e = table(spark, folder, "entities")
    s, t = F.col("surface"), F.col("heuristic_type")
    return e.groupBy("heuristic_type", R.inferred_type(s, t).alias("inferred"), R.inferred_type(s).alias("shown")).agg(F.count("*").alias("n"))


def t26_groups(spark, folder):
    e = table(spark, folder, "entities")
    return e.groupBy("heuristic_group", R.surface_group(F.col("surface")).alias("written")).agg(F.count("*").alias("n"))


def t27_signature(spark, folder):
    e = table(spark, folder, "entities").where("heuristic_group = 'numeric'")
    return e.select("id", F.array_join(N.signature(F.col("surface")), "|").alias("signature"))


def t29_domains(spark, folder):
    d = table(spark, folder, "datasets")
    p = F.split("path", "/")
    return d.select("id", R.domain_of(F.col("path")).alias("domain"), F.element_at(p, -1).alias("split"), F.element_at(p, -2).alias("name"))


def t30_ids(spark, folder):
    e = table(spark, folder, "entities")
    return e.select("id", T.stable_id(16, T.norm_key(F.col("surface"))).alias("entity_hash"), T.stable_id(20, F.col("surface_key"), F.col("heuristic_type")).alias("row_hash"))


def n03_months(spark, folder):
    t = table(spark, folder, "texts").select("id", "title")
    e = table(spark, folder, "entities").select("id", F.col("surface").alias("title"))
    rows = t.unionByName(e).withColumn("variant", N.next_month(F.col("title")))
    return rows.where("variant IS NOT NULL").select("id", "title", "variant")


def n05_currency(spark, folder):
    e = table(spark, folder, "entities")
    return e.select("id", N.swapped_currency(F.col("surface")).alias("variant")).where("variant IS NOT NULL")


def w11_aliasability(spark, folder):
    s = F.col("surface")
    score = (
        F.when(s.contains(" "), 2).otherwise(0) + F.when(s.rlike(r"\b(Inc|Corp|Ltd|Co)\b"), 2).otherwise(0)
        + F.when(s.rlike(r"^[A-Z]{2,6}$"), 3).otherwise(0) + F.when(s.rlike(r"\."), 1).otherwise(0) + F.least(F.lit(3), F.floor(F.log10(F.col("mention_count") + 1)))
    )
    rows = table(spark, folder, "entities").where("heuristic_group = 'proper_name'").select("id", "surface", score.cast("long").alias("score"))
    ranked = rows.orderBy(F.desc("score"), "id").limit(100)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    return ranked.select(rank.cast("long").alias("rank"), "id", "surface", "score")


def a02_field_counts(spark, folder):
    t = table(spark, folder, "texts").join(table(spark, folder, "datasets").select(F.col("id").alias("dataset_id"), "name", "split", "domain"), "dataset_id")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(c, F.lit("missing")).alias("value")) for c in ("name", "split", "domain")]))
    return t.select(pairs.alias("x")).groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def a10_presence(spark, folder):
    t = table(spark, folder, "texts")
    names = ["source_id", "title", "original_text", "summary", "masked_text"]
    one = t.agg(*[F.count_if(F.col(c).isNotNull() & (F.trim(c) != "")).alias(c) for c in names])
    return one.unpivot([], names, "field", "n_present")


def a22_pools(spark, folder):
    e = table(spark, folder, "entities").select(F.col("heuristic_type").alias("t"), "surface").distinct()
    grouped = e.groupingSets([["t", "surface"], ["surface"]], "t", "surface").agg(F.grouping("t").alias("all"))
    return grouped.groupBy(F.when(F.col("all") == 1, "__ALL__").otherwise(F.col("t")).alias("pool")).agg(F.count("*").alias("n"))


QUERIES = {k: f for k, f in globals().items() if callable(f) and k[0] in "mtaslkwjn" and k[1:3].isdigit() and "_" in k}

_SHOWN = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(lower(surface), '{p}') THEN '{k}' END" for k, p in R.TYPE_PATTERNS) + ")"

SQL = {
    "m01_masks": r"""
        SELECT id AS text_id, unnest(range(len(m))) AS mask_idx, unnest(m) AS mask
        FROM (SELECT id, regexp_extract_all(masked_text, '(?i)[<\[](?:ent_)?mask[>\]]') AS m FROM texts) WHERE len(m) > 0""",
    "t08_mask_counts": r"""
        SELECT text_id, n_masks, mask_count, n_masks IS DISTINCT FROM mask_count AS differs FROM (
          SELECT id AS text_id, CAST(len(regexp_extract_all(masked_text, '(?i)[<\[](?:ent_)?mask[>\]]')) AS BIGINT) AS n_masks, mask_count FROM texts)""",
    "a01_inventory": r"""
        WITH c AS (SELECT entity_id, coalesce(observed_type, 'missing') AS t, count(DISTINCT id) AS n FROM mentions WHERE entity_id IS NOT NULL GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, t) AS r, sum(n) OVER (PARTITION BY entity_id) AS s FROM c)
        SELECT entity_id, regexp_replace(lower(trim(regexp_replace(surface, '[\s\x{00A0}]+', ' ', 'g'))), '[^\p{L}\p{N}_%$£€]+', '', 'g') AS key,
          CAST(s AS BIGINT) AS n_mentions, t AS primary_type, CAST(least(s, 5) AS BIGINT) AS n_examples
        FROM r JOIN entities e ON e.id = entity_id WHERE r = 1""",
    "a03_nested_counters": """
        SELECT entity_id, coalesce(observed_type, 'missing') AS observed_type, count(DISTINCT id) AS n FROM mentions WHERE entity_id IS NOT NULL GROUP BY ALL""",
    "m03_counter_merge": """
        SELECT entity_id, coalesce(observed_type, 'missing') AS observed_type, count(DISTINCT id) AS n FROM mentions WHERE entity_id IS NOT NULL GROUP BY ALL""",
    "m04_json_counters": """
        SELECT id AS entity_id, k, CAST(json_extract_string(j, '$."' || k || '"') AS BIGINT) AS n
        FROM (SELECT id, observed_types_json AS j, unnest(json_keys(observed_types_json)) AS k FROM entities)""",
    "s16_json_props": """SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL""",
    "a24_group_counts": """SELECT heuristic_group, heuristic_type, count(*) AS n, CAST(sum(mention_count) AS BIGINT) AS mentions FROM entities GROUP BY ALL""",
    "l02_top_entities": """SELECT id, surface, mention_count FROM entities ORDER BY mention_count DESC NULLS LAST, id LIMIT 50""",
    "l05_page": """SELECT id, surface_key FROM entities ORDER BY mention_count DESC NULLS LAST, lower(surface) NULLS FIRST, id LIMIT 20 OFFSET 40""",
    "k12_balanced_export": """
        SELECT heuristic_group, id, surface, mention_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY heuristic_group ORDER BY mention_count DESC NULLS LAST, id) AS rank FROM entities)
        WHERE rank <= 10""",
    "k11_slim_export": """
        WITH e AS (SELECT id FROM entities WHERE heuristic_group = 'proper_name' ORDER BY mention_count DESC NULLS LAST, id LIMIT 100),
        m AS (SELECT DISTINCT id, entity_id, text_id, mask_idx FROM mentions WHERE entity_id IN (SELECT id FROM e)),
        s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY id) AS r FROM m) WHERE r <= 3)
        SELECT dataset_id, count(*) AS n_mentions, count(DISTINCT entity_id) AS n_entities, count(DISTINCT text_id) AS n_texts
        FROM s JOIN texts t ON t.id = s.text_id GROUP BY dataset_id""",
    "w03_topn_mentions": """
        SELECT entity_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY id) AS rank FROM (SELECT DISTINCT entity_id, id FROM mentions)) WHERE rank <= 3""",
    "w07_first_delivery": """SELECT id, min(loaded_at) AS loaded_at FROM mentions GROUP BY id""",
    "w08_last_delivery": """SELECT id, max(loaded_at) AS loaded_at FROM mentions GROUP BY id""",
    "j01_star": """
        SELECT entity_id, d.name, d.split, d.domain, count(DISTINCT m.id) AS n FROM mentions m JOIN texts t ON t.id = m.text_id JOIN datasets d ON d.id = t.dataset_id
        WHERE entity_id IS NOT NULL GROUP BY ALL""",
    "j02_rebuild": r"""
        WITH s AS (SELECT text_id, mask_idx, min(surface) AS s FROM mentions m JOIN entities e ON e.id = m.entity_id GROUP BY ALL),
        p AS (SELECT id, regexp_split_to_array(masked_text, '(?i)[<\[](?:ent_)?mask[>\]]') AS p, regexp_extract_all(masked_text, '(?i)[<\[](?:ent_)?mask[>\]]') AS k FROM texts WHERE masked_text IS NOT NULL),
        x AS (SELECT id, unnest(p) AS p, unnest(range(len(p))) AS i, k FROM p),
        r AS (SELECT x.id, string_agg(x.p || coalesce(CASE WHEN i < len(k) THEN s.s END, k[i + 1], ''), '' ORDER BY i) AS r FROM x LEFT JOIN s ON s.text_id = x.id AND s.mask_idx = x.i GROUP BY x.id)
        SELECT id AS text_id, md5(r) AS md5, CAST(length(r) AS BIGINT) AS n_chars FROM r""",
    "t09_nth_mask": r"""
        WITH p AS (SELECT id, masked_text AS t, regexp_split_to_array(masked_text, '(?i)[<\[](?:ent_)?mask[>\]]') AS p, regexp_extract_all(masked_text, '(?i)[<\[](?:ent_)?mask[>\]]') AS k FROM texts WHERE masked_text IS NOT NULL),
        x AS (SELECT id, t, len(k) AS n, unnest(p) AS p, unnest(range(len(p))) AS i, k FROM p)
        SELECT id AS text_id, md5(CASE WHEN n > 1 THEN r ELSE t END) AS md5
        FROM (SELECT id, t, n, string_agg(p || CASE WHEN i = 1 THEN 'THIS' ELSE coalesce(k[i + 1], '') END, '' ORDER BY i) AS r FROM x GROUP BY id, t, n)""",
    "t14_crop": """
        WITH m AS (SELECT DISTINCT id, entity_id, full_context FROM mentions),
        p AS (SELECT m.id, full_context AS c, surface AS s, strpos(lower(full_context), lower(surface)) AS pos FROM m JOIN entities e ON e.id = m.entity_id)
        SELECT id, CASE WHEN pos > 0 THEN trim(substring(c, greatest(1, pos - 40), pos + length(s) + 40 - greatest(1, pos - 40)), ' ') ELSE trim(substring(c, 1, 80), ' ') END AS context FROM p""",
    "t17_short_window": r"""
        WITH p AS (SELECT id, regexp_split_to_array(masked_text, '(?i)[<\[](?:ent_)?mask[>\]]') AS p, regexp_extract_all(masked_text, '(?i)[<\[](?:ent_)?mask[>\]]') AS k FROM texts),
        q AS (SELECT id, len(k) AS n, regexp_extract_all(p[1], '[\p{L}\p{N}]+') AS l,
          regexp_extract_all(array_to_string(list_transform(range(1, len(p)), lambda i: p[i + 1] || ' ' || coalesce(k[i + 1], '') || ' '), ''), '[\p{L}\p{N}]+') AS r FROM p)
        SELECT id AS text_id, CASE WHEN n > 0 THEN array_to_string(l[-2:], ' ') || ' [X] ' || array_to_string(r[1:2], ' ') END AS context FROM q""",
    "t02_keys": r"""
        WITH s AS (SELECT id, surface, trim(regexp_replace(surface, '[\s\x{00A0}]+', ' ', 'g')) AS spaced FROM entities),
        a AS (SELECT *, regexp_replace(regexp_replace(lower(spaced), '&', ' and ', 'g'), '^\s*(the|an|a)\s+', '') AS art FROM s)
        SELECT id, regexp_replace(lower(spaced), '[^\p{L}\p{N}_%$£€]+', '', 'g') AS norm_key, regexp_replace(lower(surface), '[^\p{L}\p{N}_]+', '', 'g') AS compact,
          regexp_replace(regexp_replace(art, '[''’]s?\s*$', ''), '[^a-z0-9]+', '', 'g') AS article_free, spaced FROM a""",
    "t24_surface_variants": r"""
        WITH v AS (SELECT id, surface AS s, unnest([
          CASE WHEN regexp_matches(surface, '^([A-Za-z]\.){2,}$') THEN replace(surface, '.', '') END,
          CASE WHEN regexp_matches(surface, '\b(Jr|Sr)\.') THEN regexp_replace(surface, '\b(Jr|Sr)\.', '\1', 'g') END,
          CASE WHEN regexp_matches(surface, '\bProp\. \d') THEN regexp_replace(surface, '\bProp\. ', 'Prop ', 'g') END,
          CASE WHEN contains(surface, ',') AND NOT contains(surface, '.') THEN replace(surface, ',', '') END]) AS variant FROM entities)
        SELECT DISTINCT id, variant FROM v WHERE variant IS NOT NULL AND variant <> s""",
    "t25_types": f"SELECT heuristic_type, coalesce(nullif(heuristic_type, 'UNKNOWN'), {_SHOWN}, heuristic_type, 'UNTYPED') AS inferred, coalesce({_SHOWN}, 'UNTYPED') AS shown, count(*) AS n FROM entities GROUP BY ALL",
    "t26_groups": r"""
        SELECT heuristic_group, CASE WHEN regexp_matches(surface, '\d') THEN 'numeric' WHEN NOT regexp_matches(surface, '\p{L}') THEN 'junk' WHEN upper(surface) = surface AND length(surface) > 1 THEN 'upper'
          WHEN regexp_matches(surface, '(^| )\p{Lu}') THEN 'capitalized' WHEN contains(surface, ' ') THEN 'multiword' ELSE 'lower' END AS written, count(*) AS n FROM entities GROUP BY ALL""",
    "t27_signature": r"""
        SELECT id, array_to_string(list_transform(regexp_extract_all(surface, '\d[\d,]*(?:\.\d+)?'), lambda x: replace(x, ',', '')), '|') AS signature FROM entities WHERE heuristic_group = 'numeric'""",
    "t29_domains": """
        SELECT id, CASE WHEN contains(path, 'billsum') THEN 'legal' WHEN contains(path, 'samsum') THEN 'dialogue' WHEN contains(path, 'multi_news') THEN 'multi_news' WHEN contains(path, 'cnn_dailymail') THEN 'news'
          WHEN contains(path, 'mars_test_200') THEN 'news' WHEN contains(path, 'xsum') THEN 'news_short' ELSE 'unknown' END AS domain, string_split(path, '/')[-1] AS split, string_split(path, '/')[-2] AS name FROM datasets""",
    "t30_ids": r"""
        SELECT id, substring(sha1(regexp_replace(lower(trim(regexp_replace(surface, '[\s\x{00A0}]+', ' ', 'g'))), '[^\p{L}\p{N}_%$£€]+', '', 'g')), 1, 16) AS entity_hash,
          substring(sha1(coalesce(surface_key, 'None') || chr(31) || coalesce(heuristic_type, 'None')), 1, 20) AS row_hash FROM entities""",
    "n03_months": "WITH r AS (SELECT id, title FROM texts UNION ALL SELECT id, surface FROM entities), v AS (SELECT *, CASE " + " ".join(
        f"WHEN contains(lower(title), '{a}') THEN regexp_replace(title, '(?i){a}', '{b.capitalize()}', 'g')" for a, b in zip(R.MONTHS, R.MONTHS[1:] + R.MONTHS[:1])
    ) + " END AS variant FROM r) SELECT * FROM v WHERE variant IS NOT NULL",
    "n05_currency": """
        SELECT id, variant FROM (SELECT id, CASE WHEN contains(surface, '$') THEN replace(surface, '$', '€') WHEN contains(surface, '€') THEN replace(surface, '€', '$') WHEN contains(surface, '£') THEN replace(surface, '£', '$') END AS variant FROM entities)
        WHERE variant IS NOT NULL""",
    "w11_aliasability": r"""
        WITH s AS (SELECT id, surface, CAST(CASE WHEN contains(surface, ' ') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(surface, '\b(Inc|Corp|Ltd|Co)\b') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(surface, '^[A-Z]{2,6}$') THEN 3 ELSE 0 END
          + CASE WHEN contains(surface, '.') THEN 1 ELSE 0 END + least(3, floor(log10(mention_count + 1))) AS BIGINT) AS score FROM entities WHERE heuristic_group = 'proper_name')
        SELECT row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS rank, id, surface, score FROM s ORDER BY score DESC NULLS LAST, id LIMIT 100""",
    "a02_field_counts": """
        WITH t AS (SELECT d.name, d.split, d.domain FROM texts t JOIN datasets d ON d.id = t.dataset_id)
        SELECT 'name' AS field, coalesce(name, 'missing') AS value, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 'split', coalesce(split, 'missing'), count(*) FROM t GROUP BY ALL
        UNION ALL SELECT 'domain', coalesce(domain, 'missing'), count(*) FROM t GROUP BY ALL""",
    "a10_presence": " UNION ALL ".join(
        f"SELECT '{c}' AS field, count(*) FILTER (trim({c}) <> '') AS n_present FROM texts" for c in ("source_id", "title", "original_text", "summary", "masked_text")
    ),
    "a22_pools": """
        SELECT heuristic_type AS pool, count(DISTINCT surface) AS n FROM entities GROUP BY ALL UNION ALL SELECT '__ALL__', count(DISTINCT surface) FROM entities""",
}
