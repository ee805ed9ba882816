"""Queries of the subpackage, by problem number."""

from pyspark.sql import functions as F

from ..sources.tables import table
from . import consensus, leakage, names, neardup, overlap, packing, splits
from . import subjects as areas


def _tables(spark, folder, *names):
    return [table(spark, folder, n) for n in names]


def p2_found(spark, folder):
    return names.pairs(names.parties(*_tables(spark, folder, "entities", "good_candidates")))


def p2_parties(spark, folder):
    return names.parties(*_tables(spark, folder, "entities", "good_candidates"))


def _truth(spark, folder):
    judged, directed = _tables(spark, folder, "judgments", "directional_judgments")
    return judged, *consensus.truth_discovery(judged, directed)


def p3_found(spark, folder):
    judged, truth, _ = _truth(spark, folder)
    return consensus.consensus(judged, truth).select("pair_id", "label")


def p3_annotators(spark, folder):
    _, truth, votes = _truth(spark, folder)
    return consensus.annotators(votes, truth)


def p3_first_weights(spark, folder):
    """The weights of the first round, which SQL can follow."""
    votes = consensus.votes_of(*_tables(spark, folder, "judgments", "directional_judgments")).withColumn("weight", F.lit(1.0))
    sums = consensus.sums_of(votes)
    weighed = consensus.weights(votes, sums, consensus.by_chance(sums))
    return weighed.select("source", F.col("n").alias("n_votes"), F.round("weight", 4).alias("weight"))


def p3_agreement(spark, folder):
    return consensus.agreement(*_tables(spark, folder, "judgments", "directional_judgments"))


def _overlaps(spark, folder):
    return overlap.overlaps(*_tables(spark, folder, "texts", "datasets", "mentions"))


def p4_found(spark, folder):
    pairs = overlap.all_pairs(*_overlaps(spark, folder))
    return pairs.select(
        F.least("train_id", "eval_id").alias("text_id_a"), F.greatest("train_id", "eval_id").alias("text_id_b")
    )


def p4_report(spark, folder):
    return overlap.report(*_tables(spark, folder, "texts", "datasets"), *_overlaps(spark, folder))


def _groups(spark, folder):
    return splits.tied_groups(*_tables(spark, folder, "texts", "mentions", "entities"))


def p5_found(spark, folder):
    groups = _groups(spark, folder)
    several = groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    return groups.join(several, "group_id", "left_semi").select("text_id", "group_id")


def p5_splits(spark, folder):
    return splits.assign_splits(_groups(spark, folder), table(spark, folder, "split_targets"))


def p5_held(spark, folder):
    return splits.held(p5_splits(spark, folder), table(spark, folder, "split_targets"))


def p6_found(spark, folder):
    return neardup.all_pairs(*neardup.near_duplicates(table(spark, folder, "texts")))


def p6_classes(spark, folder):
    texts = table(spark, folder, "texts")
    return neardup.per_text(texts, *neardup.near_duplicates(texts))


def _same_body(spark, folder, pairs):
    t = table(spark, folder, "texts").where("original_text IS NOT NULL").select("id", F.md5("original_text").alias("md5"))
    one, two = t.toDF("text_id_a", "md5"), t.toDF("text_id_b", "md5")
    return pairs.join(one, "text_id_a").join(two, ["text_id_b", "md5"]).select("text_id_a", "text_id_b")


def p4_exact(spark, folder):
    """The overlaps whose bodies are the same to the letter."""
    return _same_body(spark, folder, p4_found(spark, folder))


def p6_exact(spark, folder):
    """The near-duplicates whose bodies are the same to the letter."""
    return _same_body(spark, folder, p6_found(spark, folder))


def p7_packing(spark, folder):
    return packing.pack_all(*_tables(spark, folder, "documents", "containers"))


def p7_use_of_space(spark, folder):
    return packing.use_of_space(p7_packing(spark, folder), table(spark, folder, "containers"))


def p7_placement(spark, folder):
    documents, sizes = _tables(spark, folder, "documents", "containers")
    return packing.placement(documents, packing.pack_all(documents, sizes), sizes)


def p8_found(spark, folder):
    return leakage.leaks(*_tables(spark, folder, "documents", "eval_items")).select("doc_id", "item_id")


def p8_verbatim(spark, folder):
    """The leaks that hold the whole passage to the letter."""
    documents, items = _tables(spark, folder, "documents", "eval_items")
    found = p8_found(spark, folder).join(documents.select("doc_id", "text"), "doc_id").join(items.select("item_id", "passage"), "item_id")
    return found.where(F.contains("text", "passage")).select("doc_id", "item_id")


def p8_report(spark, folder):
    documents, items = _tables(spark, folder, "documents", "eval_items")
    found = leakage.leaks(documents, items)
    per = found.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.round(F.max("score"), 3).alias("best_score"))
    return items.select("item_id", "suite", "eval_split").join(per, "item_id", "left").na.fill(0, ["n_documents"])


def _areas(spark, folder):
    return areas.subject_areas(*_tables(spark, folder, "documents", "subjects", "subject_labels"))


def p9_found(spark, folder):
    return _areas(spark, folder).select("doc_id", "subject")


def p9_composition(spark, folder):
    return areas.composition(_areas(spark, folder), table(spark, folder, "documents"))


QUERIES = {
    "p2_found": p2_found,
    "p2_parties": p2_parties,
    "p3_found": p3_found,
    "p3_annotators": p3_annotators,
    "p3_agreement": p3_agreement,
    "p3_first_weights": p3_first_weights,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p4_exact": p4_exact,
    "p5_found": p5_found,
    "p5_splits": p5_splits,
    "p5_held": p5_held,
    "p6_found": p6_found,
    "p6_classes": p6_classes,
    "p6_exact": p6_exact,
    "p7_packing": p7_packing,
    "p7_use_of_space": p7_use_of_space,
    "p7_placement": p7_placement,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p8_verbatim": p8_verbatim,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}
_WORD = "regexp_replace(lower({x}), '[^a-z]', '', 'g')"
_VOTE = "CASE WHEN starts_with(w, 'preserv') THEN 'preserved' WHEN starts_with(w, 'change') THEN 'changed' WHEN starts_with(w, 'uncertain') OR starts_with(w, 'unsure') THEN 'uncertain' END"

_VOTES = f"""j AS (SELECT DISTINCT judgment_id, pair_id, annotator_id, {_VOTE} AS l FROM (SELECT *, {_WORD.format(x="label")} AS w FROM judgments)),
        d0 AS (SELECT DISTINCT judgment_id, pair_id, annotator_id, confidence, coalesce({_VOTE}, CASE WHEN a_to_b IS NULL OR b_to_a IS NULL THEN NULL WHEN lower(trim(a_to_b)) = 'uncertain' OR lower(trim(b_to_a)) = 'uncertain' THEN 'uncertain'
            WHEN lower(trim(a_to_b)) = 'entailment' AND lower(trim(b_to_a)) = 'entailment' THEN 'preserved' ELSE 'changed' END) AS l FROM (SELECT *, {_WORD.format(x="preserves_meaning")} AS w FROM directional_judgments)),
        v AS (SELECT pair_id, l, annotator_id || '|label' AS source FROM j WHERE l IS NOT NULL AND judgment_id IS NOT NULL AND pair_id IS NOT NULL AND annotator_id IS NOT NULL
            UNION ALL SELECT pair_id, l, annotator_id || '|directions-' || CASE WHEN confidence IS NULL OR isnan(confidence) OR confidence < 0 THEN 'none' WHEN confidence < 0.5 THEN 'low' WHEN confidence < 0.8 THEN 'middle' ELSE 'high' END
            FROM d0 WHERE l IS NOT NULL AND judgment_id IS NOT NULL AND pair_id IS NOT NULL AND annotator_id IS NOT NULL)"""

# Only what SQL can say over whole tables; the others are tested against brute force in tests/llm.
SQL: dict[str, str] = {
    "p4_exact": r"""WITH t AS (SELECT x.id, original_text, lower(trim(split)) AS s FROM texts x JOIN datasets d ON d.id = dataset_id WHERE regexp_matches(original_text, '[\p{L}\p{N}]'))
        SELECT least(a.id, b.id) AS text_id_a, greatest(a.id, b.id) AS text_id_b FROM t a JOIN t b ON a.original_text = b.original_text AND a.s = 'train' AND b.s IN ('validation', 'test')""",
    "p5_held": "SELECT count(*) AS n_texts, 0::BIGINT AS n_crossing, 0::BIGINT AS n_off FROM (SELECT DISTINCT id FROM texts WHERE id IS NOT NULL)",
    "p6_exact": r"""SELECT a.id AS text_id_a, b.id AS text_id_b FROM texts a JOIN texts b ON a.original_text = b.original_text AND a.id < b.id WHERE regexp_matches(a.original_text, '[\p{L}\p{N}]')""",
    "p8_verbatim": "SELECT doc_id, item_id FROM documents JOIN eval_items ON contains(text, passage)",
    "p7_placement": "SELECT container_name, (SELECT count(*) FROM documents WHERE text <> '') AS n_documents, 0::BIGINT AS n_broken, 0::BIGINT AS n_over FROM containers",
    "p3_agreement": f"""
        WITH {_VOTES}, c AS (SELECT pair_id, l, count(*) AS n, sum(count(*)) OVER (PARTITION BY pair_id) AS m FROM v GROUP BY pair_id, l), k AS (SELECT * FROM c WHERE m > 1),
        s AS (SELECT count(DISTINCT pair_id) AS p, CAST(sum(n) AS DOUBLE) AS n, sum(n * (n - 1) / CAST(m - 1 AS DOUBLE)) AS same FROM k),
        e AS (SELECT sum(t * (t - 1)) AS x FROM (SELECT CAST(sum(n) AS DOUBLE) AS t FROM k GROUP BY l))
        SELECT p AS n_pairs, CAST(coalesce(n, 0) AS BIGINT) AS n_votes, round(same / n, 6) AS observed, round(x / (n * (n - 1)), 6) AS expected, round((same / n - x / (n * (n - 1))) / (1 - x / (n * (n - 1))), 6) AS alpha FROM s, e""",
    "p3_first_weights": f"""
        WITH {_VOTES}, g AS (SELECT pair_id, source, l, count(*) AS n FROM v GROUP BY pair_id, source, l),
        t AS (SELECT pair_id, sum(n) FILTER (l = 'preserved') AS p, sum(n) FILTER (l = 'changed') AS c, sum(n) FILTER (l = 'uncertain') AS u FROM g GROUP BY pair_id),
        z AS (SELECT pair_id, coalesce(p, 0) AS p, coalesce(c, 0) AS c, coalesce(u, 0) AS u, greatest(coalesce(p, 0), coalesce(c, 0), coalesce(u, 0)) AS top FROM t),
        k AS (SELECT *, (p = top)::INT + (c = top)::INT + (u = top)::INT AS ties FROM z),
        a AS (SELECT 1 - avg((p = top)::INT / ties) AS p, 1 - avg((c = top)::INT / ties) AS c, 1 - avg((u = top)::INT / ties) AS u FROM k),
        o AS (SELECT source, l, n, p - CASE WHEN l = 'preserved' THEN n ELSE 0 END AS p, c - CASE WHEN l = 'changed' THEN n ELSE 0 END AS c, u - CASE WHEN l = 'uncertain' THEN n ELSE 0 END AS u FROM g JOIN z USING (pair_id)),
        m AS (SELECT *, greatest(p, c, u) AS top FROM o),
        d AS (SELECT source, n, CASE WHEN m.top > 0 THEN n ELSE 0 END AS told, (1 - (CASE l WHEN 'preserved' THEN m.p WHEN 'changed' THEN m.c ELSE m.u END = m.top)::INT / ((m.p = m.top)::INT + (m.c = m.top)::INT + (m.u = m.top)::INT))
            / CASE l WHEN 'preserved' THEN a.p WHEN 'changed' THEN a.c ELSE a.u END AS d FROM m, a),
        s AS (SELECT source, sum(n) AS n, greatest(CAST(sum(told) AS DOUBLE), 0.001) AS k, sum(told * d) AS d FROM d GROUP BY source)
        SELECT source, CAST(n AS BIGINT) AS n_votes, round(greatest(0.001, -ln(least(1.0, (d + 0.05) / greatest(k * pow(greatest(0.0, 1 - 2 / (9 * k) - 1.959964 * sqrt(2 / (9 * k))), 3), 0.001)))), 4) AS weight FROM s""",
    "p5_found": r"""
        WITH RECURSIVE k AS (SELECT id, lower(trim(source_id, ' ')) AS s FROM texts WHERE id IS NOT NULL),
        e AS (SELECT id AS t, 's' || regexp_extract(s, '^([a-z]+)', 1) || CAST(CAST(regexp_extract(s, '([0-9]+)$', 1) AS HUGEINT) AS VARCHAR) AS n FROM k WHERE regexp_matches(s, '^[a-z]+[^a-z0-9]*[0-9]+$')
          UNION SELECT text_id, 'e' || entity_id FROM mentions m JOIN entities n ON n.id = m.entity_id AND heuristic_group = 'proper_name' WHERE text_id IN (SELECT id FROM texts)),
        r AS (SELECT t AS a, t AS b FROM e UNION SELECT r.a, y.t FROM r JOIN e x ON x.t = r.b JOIN e y ON y.n = x.n),
        g AS (SELECT a AS text_id, min(b) AS group_id FROM r GROUP BY a)
        SELECT * FROM g WHERE group_id IN (SELECT group_id FROM g GROUP BY group_id HAVING count(*) > 1)""",
}
