"""Candidate generators: rule pairs, numeric pairs, lexicon synonyms, and their review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import rules as R
from ..functions import text as T
from ..functions import variants as V
from ..functions.aliases import alias_candidates, index, resource
from .cleaning import same_type_negatives
from .inventory import top_per_group
from .skew import lookup

# Suffixes of plural forms, longest first, and what replaces each.
PLURALS = {"ies": "y", "ves": "f", "ches": "ch", "shes": "sh", "ses": "s", "xes": "x", "zes": "z", "s": ""}
# A small lexicon of common words; words of a line share a sense.
SENSES = {
    "person.n.01": "officials authorities leaders", "inhabitant.n.01": "residents locals inhabitants neighbors", "worker.n.01": "workers employees staff",
    "expert.n.01": "experts specialists", "student.n.01": "students pupils", "critic.n.01": "critics reviewers", "family.n.01": "families households",
    "investor.n.01": "investors shareholders", "witness.n.01": "witnesses observers", "member.n.01": "members associates", "organizer.n.01": "organizers planners",
    "day.n.01": "yesterday today tomorrow", "city.n.01": "capital city town", "owner.n.01": "owner proprietor", "relative.n.01": "relative cousin kin",
}

_WORDS = 8  # of a name whose sets of words are listed, at most 255


def lexicon(spark: SparkSession) -> DataFrame:
    """``word, sense``."""
    return spark.createDataFrame([(w, s) for s, ws in SENSES.items() for w in ws.split()], "word string, sense string")


def morphology_key(surface: Column) -> Column:
    """The last word with its plural suffix undone, the first that fits; shorter words stay."""
    low = F.lower(surface)
    out = None
    for suffix, put in PLURALS.items():
        hit = low.endswith(suffix) & (F.length(low) > len(suffix) + 2)
        cut = F.concat(F.substring(low, F.lit(1), F.length(low) - len(suffix)), F.lit(put))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(low)


def synonyms(words: DataFrame, word: str, spark: SparkSession) -> DataFrame:
    """``word, candidate, n_senses``: other words that share a sense with a word, by equi-joins on word and sense."""
    lex = F.broadcast(lexicon(spark))  # a fixed table
    mine = words.select(F.lower(word).alias("word")).distinct().join(lex, "word")
    other = lex.select(F.col("word").alias("candidate"), "sense")
    met = mine.join(F.broadcast(other), "sense").where("word <> candidate")
    return met.groupBy("word", "candidate").agg(F.count_distinct("sense").alias("n_senses"))


def rule_pairs(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """``mention_id, candidate, pair_kind, label``: identity, surface, alias, numeric and same-type pairs of every mention.

    Variants are computed once per entity and then joined to its mentions; repeated (mention, candidate key,
    label) keep the first kind in the order below. Aliases that depend on the context have no label: they are for review.
    """
    s = F.col("surface")
    numeric = F.concat(V.perturbed(s), F.array_compact(F.array(N.next_month(s))))
    kinds = F.array(
        F.struct(F.lit(0).alias("o"), F.lit("positive_identity").alias("k"), F.lit(1).alias("label"), F.array(s).alias("v")),
        F.struct(F.lit(1).alias("o"), F.lit("positive_surface").alias("k"), F.lit(1).alias("label"), T.surface_variants(s).alias("v")),
        F.struct(F.lit(2).alias("o"), F.lit("positive_alias").alias("k"), F.lit(1).alias("label"), F.slice("strict", 1, 4).alias("v")),
        F.struct(F.lit(3).alias("o"), F.lit("context_sensitive_alias_candidate").alias("k"), F.lit(None).cast("int").alias("label"), F.slice("review", 1, 3).alias("v")),
        F.struct(F.lit(4).alias("o"), F.lit("negative_numeric_or_date_perturbation").alias("k"), F.lit(0).alias("label"), F.slice(numeric, 1, 3).alias("v")),
    )
    named = alias_candidates(entities.select("id", "surface"), s, index(resource(entities.sparkSession)))
    per_entity = named.select(F.col("id").alias("entity_id"), F.explode(kinds).alias("x")).select("entity_id", "x.o", "x.k", "x.label", F.explode("x.v").alias("candidate"))
    distinct = per_entity.groupBy("entity_id", T.norm_key(F.col("candidate")).alias("key"), "label").agg(F.min(F.struct("o", "k", "candidate")).alias("y"))
    # One row per entity, so that joining the mentions, however many an entity has, moves each mention once.
    lists = distinct.groupBy("entity_id").agg(F.collect_list(F.struct("y.candidate", F.col("y.k").alias("pair_kind"), "label")).alias("rules"))
    facts = mentions.select(F.col("id").alias("mention_id"), "entity_id").distinct()
    per = facts.groupBy("entity_id").agg(F.count("*").alias("n_mentions"))
    rules = lookup(facts, lists.join(per, "entity_id"), "entity_id", "n_mentions").select("mention_id", F.inline("rules"))
    negatives = same_type_negatives(mentions, entities).select(F.col("id").alias("mention_id"), "candidate", F.lit("negative_same_type").alias("pair_kind"), F.lit(0).alias("label"))
    return rules.unionByName(negatives)


# Types of numeric surfaces.
NUMERIC_TYPES = ("DATE", "TIME", "CARDINAL", "ORDINAL", "MONEY", "PERCENT", "QUANTITY")


def numeric_pairs(entities: DataFrame, mentions: DataFrame, equivalents: int = 1, changed: int = 2) -> DataFrame:
    """``mention_id, candidate, kind``: for mentions of numeric entities a few equivalent and a few changed values."""
    numeric = entities.where(F.col("heuristic_group").eqNullSafe("numeric") & F.col("heuristic_type").isin(*NUMERIC_TYPES))
    s, t = F.col("surface"), F.col("heuristic_type")
    both = F.concat(
        F.transform(F.slice(V.equivalents(s, t), 1, equivalents), lambda v: F.struct(v.alias("candidate"), F.lit("numeric_equivalent_format").alias("kind"))),
        F.transform(F.slice(V.changed(s, t), 1, changed), lambda v: F.struct(v.alias("candidate"), F.lit("numeric_close_changed").alias("kind"))),
    )
    facts = mentions.select(F.col("id").alias("mention_id"), "entity_id").distinct()
    per = facts.groupBy("entity_id").agg(F.count("*").alias("n_mentions"))
    made = numeric.select(F.col("id").alias("entity_id"), both.alias("made")).join(per, "entity_id")
    return lookup(facts, made, "entity_id", "n_mentions").select("mention_id", F.inline("made"))


def proper_pool(entities: DataFrame, per_entity: int = 3, least: float = 0.18) -> DataFrame:
    """``entity_id, candidate_id, score``: other proper names of the same type that share a word, by word overlap.

    No word is too common. Among names of one size that have a given set of words, a later one has its overlap
    with a name of just these shared words beaten or matched by all earlier ones, so the first ``per_entity``
    besides the name itself suffice for every set of its words. That is exact, and linear in the names however
    many share a word. Names of more than ``_WORDS`` words have too many sets and meet at single words instead.
    """
    named = entities.where("heuristic_group = 'proper_name'").select("id", F.col("heuristic_type").alias("t"), F.array_sort(F.array_distinct(T.tokens(F.col("surface")))).alias("w"))
    named = named.where("t IS NOT NULL AND size(w) > 0").distinct()
    sets = "transform(sequence(1, shiftleft(1, size(w)) - 1), m -> array_join(filter(w, (x, i) -> shiftright(m, i) & 1 = 1), ' '))"
    short = named.where(F.size("w") <= _WORDS).withColumn("key", F.explode(F.expr(sets)))
    first = top_per_group(short.withColumn("size", F.size("w")), ["t", "key", "size"], per_entity + 1, F.col("id")).select("t", "key", F.col("id").alias("candidate_id"), F.col("w").alias("v"))
    words = named.withColumn("key", F.explode("w"))
    every = words.select("t", "key", F.col("id").alias("candidate_id"), F.col("w").alias("v"))
    many = short.join(first, ["t", "key"]).unionByName(words.where(F.size("w") > _WORDS).join(every, ["t", "key"]))
    many = many.unionByName(words.where(F.size("w") <= _WORDS).join(every.where(F.size("v") > _WORDS), ["t", "key"]))
    score = T.jaccard(F.col("w"), F.col("v"))
    met = many.where("id <> candidate_id").select(F.col("id").alias("entity_id"), "candidate_id", F.round(score, 6).alias("score")).distinct()
    return top_per_group(met.where(F.col("score") >= least), ["entity_id"], per_entity, F.desc("score"), F.col("candidate_id")).select("entity_id", "candidate_id", "score", F.col("rank").cast("long"))


def weak_reason(surface: Column, candidate: Column, cosine: Column) -> Column:
    """Why a pair gets which weak label: identity, morphological variant, or by cosine band."""
    return (
        F.when(F.lower(surface) == F.lower(candidate), "identity")
        .when(morphology_key(surface) == morphology_key(candidate), "morphological_variant")
        .when(cosine >= 0.97, "very_high").when(cosine >= 0.9, "high").when(cosine >= 0.82, "medium").otherwise("excluded")
    )


def weak_label(reason: Column) -> Column:
    """The label that a reason stands for."""
    return F.when(reason.isin("identity", "morphological_variant", "very_high"), "positive").when(reason == "high", "hard_negative").when(reason == "medium", "medium_negative").otherwise("excluded")


def clean_surface(surface: Column) -> Column:
    """A common word fit for substitution: 3 to 64 characters, no digit, no temporal word, at most four words."""
    words = T.tokens(surface)
    temporal = F.array(*[F.lit(x) for x in (*R.MONTHS, "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "today", "yesterday", "tomorrow", "week", "year")])
    return F.length(surface).between(3, 64) & ~surface.rlike(r"\d") & ~F.arrays_overlap(words, temporal) & F.size(words).between(1, 4)


# Words that name nothing in particular, words a name does not begin with, number words, times of day and year.
GENERIC = "more less other same this that these those something anything everything someone anyone people".split()
LEADING = (
    "a an the this that these those my your his her its our their some any each every either neither many much few several all both another as"
).split()
NUMBERS = (
    r"\b(zeros?|ones?|twos?|threes?|four(s|ths)?|fives?|six(es|ths)?|seven(s|ths)?|eight(s|hs)?|nine(s|ths)?|ten(s|ths)?|eleven(s|ths)?|twelve(s|ths)?|thirteen|fourteen|fifteen|sixteen|"
    r"seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|trillion|dozen|half|quarter|hundredth|thousandth|millionth|billionth)\b"
)
TIMES = r"\b(age|today|tomorrow|yesterday|morning|afternoon|evening|night|weekend|weekday|semester|daily|weekly|monthly|annual|annually|quarterly)\b"
POLAR = r"^(anti|pro|non|un|pre|post|ex|pan|sub)-"
SHAPE = r"^[a-z]+(?:['-][a-z]+)*(?: [a-z]+(?:['-][a-z]+)*){0,3}$"
# Units and times; both their singular and their plural are no names.
UNITS = (
    "second minute hour day week month year decade age weekend weekday night morning afternoon evening meter metre mile inch kilometer kilometre gram kilogram pound dollar euro "
    "million billion trillion hundred thousand gallon millimeter millimetre centimeter centimetre ton holiday moment"
).split()


def strict_surface(surface: Column, not_lexical: tuple[str, ...] = ()) -> Column:
    """A clean common word that is also lexical: lower-case words, at most four, none of them a unit, a time, a number or in ``not_lexical``."""
    x = T.normalize_space(surface)
    words = F.regexp_extract_all(x, F.lit("[a-z]+"), F.lit(0))
    barred = F.array(*[F.lit(w) for w in sorted({*UNITS, *(u + "s" for u in UNITS), *not_lexical})])
    low = F.lower(x)
    return (
        F.length(x).between(3, 64) & ~x.rlike(r"\d") & ~low.rlike(NUMBERS) & ~low.rlike(TIMES) & ~low.isin(*GENERIC) & (x == low) & x.rlike(SHAPE)
        & ~F.coalesce(F.get(words, F.lit(0)).isin(*LEADING), F.lit(True)) & ~F.arrays_overlap(words, barred) & ~x.rlike(POLAR)
    )


def simple_inflection(a: Column, b: Column) -> Column:
    """One single word is the plural of the other: s, es, y to ies, f to ves."""
    x, y = F.lower(T.normalize_space(a)), F.lower(T.normalize_space(b))

    def plural(one: Column, many: Column) -> Column:
        stem = F.substring(one, F.lit(1), F.length(one) - 1)
        return (
            (many == F.concat(one, F.lit("s"))) | (many == F.concat(one, F.lit("es")))
            | (F.endswith(one, F.lit("y")) & (many == F.concat(stem, F.lit("ies")))) | (F.endswith(one, F.lit("f")) & (many == F.concat(stem, F.lit("ves"))))
        )

    return ~x.contains(" ") & ~y.contains(" ") & (plural(x, y) | plural(y, x))


def sampled_pool(entities: DataFrame, per_entity: int = 3, seed: str = "19") -> DataFrame:
    """``entity_id, candidate_id``: of the ``3 * per_entity`` closest names of each, ``per_entity`` in the order of a hash."""
    head = proper_pool(entities, 3 * per_entity)
    draw = F.sha1(F.concat_ws("|", F.lit(seed), F.col("entity_id").cast("string"), F.col("candidate_id").cast("string")))
    return top_per_group(head.drop("rank"), ["entity_id"], per_entity, draw, F.col("candidate_id")).select("entity_id", "candidate_id")
