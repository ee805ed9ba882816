"""Spellings of one person or organisation linked by canonical rewritings, scored by their rarity.

Each name is rewritten by nickname, initial, title, legal-form and token-order rules to canonical keys, and
every key to the forms it takes with one letter left out or with letters that look alike made equal. Names
and forms are exploded and equi-joined. Equal keys are one party. A shared weaker form counts by how rare it is: two keys one edit
apart are joined when one of both is rare against the other, and a name that leaves something open (an
initial, a bare surname, a nickname of several names, an acronym) goes to the party of whose names the form comes, if hardly
any other name makes it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import cut
from ..operators.components import connected_components
from ._text import _FOLD

# Given names and their short forms in common English use.
NICKNAMES = {
    "abigail": "abby", "albert": "al bert", "alexander": "alex", "amanda": "mandy", "andrew": "andy drew", "angela": "angie",
    "anthony": "tony", "arthur": "art", "augustus": "gus", "barbara": "barb", "benjamin": "ben", "bernard": "bernie",
    "charles": "charlie chuck", "christine": "chris chrissy", "christopher": "chris kit", "clifford": "cliff", "cynthia": "cindy",
    "daniel": "dan danny", "deborah": "deb debbie", "dominic": "dom", "dorothy": "dot dottie", "douglas": "doug",
    "edward": "ed eddie ted", "elizabeth": "liz beth betty lizzie", "ernest": "ernie", "eugene": "gene", "francis": "frank",
    "frederick": "fred freddie", "gabriela": "gabi gaby", "gerald": "gerry jerry", "gilbert": "gil", "gregory": "greg",
    "gwendolyn": "gwen", "harold": "hal harry", "henry": "hank harry", "ignatius": "iggy", "isabella": "bella izzy",
    "jacqueline": "jackie", "james": "jim jimmy jamie", "jeffrey": "jeff", "jennifer": "jen jenny", "jonathan": "jon",
    "joseph": "joe joey", "josephine": "jo josie", "joshua": "josh", "judith": "judy", "katherine": "kate kathy katie",
    "kenneth": "ken kenny", "lawrence": "larry", "leonard": "len lenny leo", "lucas": "luke", "madeline": "maddy",
    "margaret": "maggie peggy meg", "matthew": "matt", "maxwell": "max", "melvin": "mel", "michael": "mike mick",
    "natalie": "nat", "nathaniel": "nate nat", "nicholas": "nick", "norman": "norm", "oliver": "ollie", "oscar": "ozzie",
    "pamela": "pam", "patricia": "pat patty trish tricia", "penelope": "penny", "peter": "pete", "philip": "phil",
    "quentin": "quin", "raymond": "ray", "rebecca": "becky becca", "richard": "rick dick rich", "robert": "bob rob bobby",
    "rosemary": "rosie rose", "rudolph": "rudy", "russell": "russ", "samuel": "sam sammy", "sandra": "sandy",
    "stanley": "stan", "stephanie": "steph", "steven": "steve", "susan": "sue susie", "sylvester": "sly",
    "theodore": "ted theo", "theresa": "terry tess", "thomas": "tom tommy", "timothy": "tim", "tobias": "toby",
    "ulysses": "uly", "valerie": "val", "veronica": "ronnie vera", "victoria": "vicky tori", "vincent": "vince",
    "walter": "walt", "william": "will bill billy", "winifred": "winnie", "zachary": "zach zack",
}
# Titles, and words of legal forms with their abbreviations.
TITLES = frozenset(
    "mr mrs ms miss dr prof professor sir dame lord lady judge justice sen senator rep gov governor capt captain col colonel "
    "gen general lt sgt maj major minister president chancellor mayor rev father sister".split()
)
LEGAL = frozenset(
    "university univ institute inst association assn assoc federation fed corporation corp department dept international intl "
    "incorporated inc limited ltd group grp company co trust holdings manufacturing mfg brothers bros llc plc".split()
)
LINKERS = frozenset(("the", "of", "and"))
PEOPLE, NOISE = frozenset(("PERSON", "ORG")), frozenset(("NORP", "WORK_OF_ART", "UNTYPED", "UNKNOWN", "OTHER", "COMMON_NOUN", "JUNK", ""))
_FORMAL: dict[str, tuple[str, ...]] = {}
for _name, _short in NICKNAMES.items():
    for _x in (_name, *_short.split()):
        _FORMAL[_x] = (*_FORMAL.get(_x, ()), _name)
_DIGITS = str.maketrans("0135", "oles")
LONG = 9  # letters of a surname in which two edits leave it recognisable
RARE = 2.0  # bits: at most a quarter of the names that make a form are of other parties


def alike(a: str, b: str) -> bool:
    """One edit apart, or two neighbouring letters swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x == y[1:] or x[1:] == y or x[1:] == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])


def folded(key: str) -> str:
    """The key with letters made equal that look alike in print: what is no evidence by itself."""
    return key.replace("rn", "m").replace("vv", "w").replace("cl", "d")


def shortened(word: str) -> set[str]:
    """The word, and, of five letters or more, the word with one letter left out."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) > 4 else {word}


_FORMAL_FORMS: dict[str, set[str]] = {}
_LEGAL_FORMS: dict[str, set[str]] = {}
for _words, _forms in ((NICKNAMES, _FORMAL_FORMS), ([w for w in LEGAL if len(w) > 6], _LEGAL_FORMS)):
    for _x in _words:
        for _f in shortened(_x):
            _forms.setdefault(_f, set()).add(_x)


def _misspelt(word: str, forms: dict[str, set[str]]) -> str | None:
    met = {x for f in shortened(word) for x in forms.get(f, ()) if alike(word, x)} if len(word) > 4 else set()
    return met.pop() if len(met) == 1 else None


def tokens(surface: str) -> list[str]:
    """Lower-case words without accents and look-alikes; digits among several letters are read as the letters they look like."""
    text = unicodedata.normalize("NFKC", surface).lower().translate(_FOLD)
    out = re.findall(r"[^\W_]+", re.sub(r"['’]s\b|['’]", "", text))
    return [t.translate(_DIGITS) if len(re.findall(r"[a-z]", t)) > 3 else t for t in out]


def given(word: str) -> tuple[str, ...]:
    """The full given names that a given name may stand for."""
    return _FORMAL.get(word) or ((m,) if (m := _misspelt(word, _FORMAL_FORMS)) else (word,))


def _known(word: str) -> bool:
    return word in _FORMAL


def rewrite(surface: str) -> list[tuple[str, str, str, bool]]:
    """Canonical rewritings ``(kind, key, open, sure)`` of a name.

    kind P: key "surname", open "given name" or several of them; kind I: key "surname", open "initial";
    kind S: key "surname"; kind O: key "core words, sorted"; kind A: key "acronym". ``sure``: the form
    itself shows a person or an organisation. Initials of an organisation are in ``open``.
    """
    bare = re.sub(r"\([^()]*\)|[\"“”][^\"“”]*[\"“”]", " ", surface)
    words = tokens(bare)
    if not words or not any(re.search(r"[^\W\d_]", w) for w in words):
        return []
    legal = [w in LEGAL or _misspelt(w, _LEGAL_FORMS) is not None for w in words]
    if any(legal) and len(words) > 1:
        core = [w for w, x in zip(words, legal) if not x and w not in LINKERS]
        initials = "" if legal[0] else "".join(w[0] for w in words if w not in LINKERS)
        return [("O", " ".join(sorted(core)), initials, True)] if core else []
    titled = any(w in TITLES for w in words[:2]) and len(words) > 1
    if "," in bare:
        left, _, right = bare.partition(",")
        sur, rest = tokens(left), [w for w in tokens(right) if w not in TITLES]
        if sur and rest:
            key = sur[-1]
            return [("I", key, rest[0], True)] if len(rest[0]) == 1 else [("P", key, "|".join(given(rest[0])), _known(rest[0]))]
    words = [w for w in words if w not in TITLES] or words
    thing = words[0] == "the"
    words = [w for w in words if w not in LINKERS]
    if not words:
        return []
    if len(words) == 1:
        out = [("S", words[0], "", titled)]
        if 2 <= len(words[0]) <= 6 and not titled:
            out.append(("A", words[0], "", False))
        return out
    full = [w for w in words if len(w) > 1]
    if not full:
        return []
    if len(full) == 1:
        letter = words[0] if len(words[0]) == 1 else words[-1]
        return [("I", full[0], letter, True)]
    if len(words[0]) == 1:
        return [("I", full[-1], words[0], True)]
    first, last = full[0], full[-1]
    if _known(last) and not _known(first):
        first, last = last, first
    out = [("P", last, "|".join(given(first)), titled or _known(first))]
    if not titled and not _known(first) and len(full) == 2:
        out.append(("O", " ".join(sorted(full)), "", thing))
    return out


def within_two(a: str, b: str) -> bool:
    """At most two edits (a letter put in, left out or changed, or two neighbours swapped) lie between the words."""
    if abs(len(a) - len(b)) > 2:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    swapped = x[1:2] + x[:1] + x[2:] if len(x) > 1 else x
    return any(p == q or alike(p, q) for p, q in ((x, y[1:]), (x[1:], y), (x[1:], y[1:]), (swapped, y), (x, y)))


def forms(kind: str, key: str, open_: str) -> set[str]:
    """The weaker forms of a key: one letter of one word left out, two of a long surname, or look-alike letters made equal."""
    alike_ = {f"L{kind}|{open_}|{folded(key)}"}
    if kind == "P":
        once = shortened(key)
        twice = {f"D|{open_}|{w[:i] + w[i + 1 :]}" for w in once for i in range(len(w))} if len(key) >= LONG else set()
        return alike_ | twice | {f"{k}|{open_}|{s}" for s in once for k in ("PD" if len(key) >= LONG else "P")}
    parts = key.split(" ")
    if len(parts) < 2:
        return alike_ | {f"O||{key}"}
    return alike_ | {f"O|{' '.join(parts[:i] + parts[i + 1 :])}|{s}" for i, w in enumerate(parts) for s in shortened(w)}


def one_edit(kind: str, a: str, b: str) -> bool:
    """The keys differ by one edit of one word."""
    if kind == "P":
        return alike(a, b)
    x, y = a.split(" "), b.split(" ")
    only_x, only_y = [w for w in x if w not in y], [w for w in y if w not in x]
    return len(only_x) == len(only_y) == 1 and alike(only_x[0], only_y[0])


def main_type(observed: str | None, heuristic: str | None) -> str:
    """The type most mentions have; noise only if there is nothing else; the heuristic one without any."""
    try:
        counts = json.loads(observed) if observed else {}
    except ValueError:
        counts = {}
    counts = {k: n for k, n in counts.items() if isinstance(n, (int, float))} if isinstance(counts, dict) else {}
    telling = {k: n for k, n in counts.items() if k not in NOISE} or counts
    return min(telling, key=lambda k: (-telling[k], k)) if telling else heuristic or ""


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for name, surface, observed, heuristic in batch.itertuples(index=False):
            kind_of = main_type(observed, heuristic) if name[0] == "e" else "PERSON"
            for kind, key, open_, sure in rewrite(surface or ""):
                if kind_of in PEOPLE or kind_of in NOISE or sure:
                    out.append((name, kind, key, open_))
        yield pd.DataFrame(out, columns=["name", "kind", "key", "open"])


_NAME = "name string, kind string, key string, open string"


def names_of(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """``name, surface, observed, heuristic``: entities as e + id, candidates as g + candidate_id, each once.

    Null ids or surfaces give no name; of a candidate_id with several texts the smallest counts. What a candidate
    was proposed for is not looked at.
    """
    e = entities.where("id IS NOT NULL AND surface IS NOT NULL").groupBy("id").agg(
        F.min("surface").alias("surface"), F.min("observed_types_json").alias("observed"), F.min("heuristic_type").alias("heuristic")
    )
    g = candidates.where("candidate_id IS NOT NULL AND candidate IS NOT NULL").groupBy("candidate_id").agg(F.min("candidate").alias("surface"))
    none = F.lit(None).cast("string")
    return e.select(F.concat(F.lit("e"), "id").alias("name"), "surface", "observed", "heuristic").unionByName(
        g.select(F.concat(F.lit("g"), "candidate_id").alias("name"), "surface", none.alias("observed"), none.alias("heuristic"))
    )


def _typos(nodes: DataFrame) -> DataFrame:
    """``src, dst``: keys that share a weaker form, of which one is rare against the other.

    One edit apart, a key of one or two names is rare enough. Two edits of a long surname and look-alike letters are
    weaker evidence: there the other must have twice as many names.
    """

    def spread(batches):
        for batch in batches:
            out = [(n, k, key, c, f) for n, k, key, o, c in batch.itertuples(index=False) for f in forms(k, key, o)]
            yield pd.DataFrame(out, columns=["node", "kind", "key", "n_names", "form"])

    def confirm(batches):
        for batch in batches:
            keep = [
                high >= 2 * low and (f[0] == "L" or within_two(a, b)) if f[0] in "LD" else one_edit(k, a, b)
                for f, k, a, b, low, high in zip(batch["form"], batch["kind"], batch["key"], batch["key2"], batch["low"], batch["high"])
            ]
            yield batch.loc[keep, ["src", "dst"]]

    made = nodes.select("node", "kind", "key", "open", "n_names").mapInPandas(spread, "node long, kind string, key string, n_names long, form string")
    made = cut(made, "forms")
    met = made.groupBy("form").agg(F.count("*").alias("keys")).where("keys > 1").select("form")
    one = made.join(met, "form", "left_semi").select(F.col("node").alias("src"), "kind", "key", "n_names", "form")
    two = made.select(F.col("node").alias("dst"), F.col("key").alias("key2"), F.col("n_names").alias("n2"), "form")
    low, high = F.least("n_names", "n2"), F.greatest("n_names", "n2")
    pairs_ = one.join(two, "form").where(F.col("src") < F.col("dst")).select("src", "dst", "kind", "key", "key2", "form", low.alias("low"), high.alias("high"))
    return pairs_.where("low <= 2 OR high >= 3 * low").mapInPandas(confirm, "src long, dst long").distinct()


def _settle(open_names: DataFrame, made: DataFrame) -> DataFrame:
    """``name, party``: where a name's forms come from parties, the party for which they are rare enough elsewhere.

    ``open_names`` has name, asked, forms (all rewritings of what is ``asked``); ``made`` form, party, n, the names of
    the party that make the form. The score of a party is minus the binary logarithm of the share of other parties' names
    among those that make any of the forms; RARE or more links. Names that ask the same are settled
    together, so a frequent surname costs no more.
    """
    asked = open_names.groupBy("asked").agg(F.first("forms").alias("forms")).select("asked", F.explode("forms").alias("form"))
    per = made.groupBy("form", "party").agg(F.sum("n").alias("n"))
    met = asked.join(per, "form").groupBy("asked", "party").agg(F.max("n").alias("n"))
    best = met.groupBy("asked").agg(F.sum("n").alias("all"), F.max_by("party", F.struct("n", -F.col("party"))).alias("party"), F.max("n").alias("n"))
    outside = (F.col("all") - F.col("n")) / F.col("all")
    score = -F.log2(F.greatest(outside, F.lit(2.0**-30)))
    return open_names.select("name", "asked").join(best.where(score >= RARE).select("asked", "party"), "asked").select("name", "party").distinct()


def _number(*parts: Column) -> Column:
    """A node for what the parts say, never negative."""
    return F.xxhash64(*parts).bitwiseAND(F.lit((1 << 62) - 1))


def parties(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """``name, party``: one row per name that is a person or an organisation, linked or not.

    Places and other things are left out by the type most of their mentions have, unless the form of the
    name shows a person or organisation. Empty or wordless surfaces have no row; repeated rows count once;
    empty tables give an empty result; extra columns are not read.
    """
    parsed = cut(names_of(entities, candidates).mapInPandas(_parse, _NAME), "names")
    several = F.col("open").contains("|")
    marked = parsed.where((F.col("kind") == "O") | ((F.col("kind") == "P") & ~several))
    marked = marked.withColumn("node", _number(F.col("kind"), F.col("key"), F.when(F.col("kind") == "P", F.col("open")).otherwise("")))
    given_ = F.when(F.col("kind") == "P", F.col("open")).otherwise("")
    nodes = cut(marked.groupBy("node", "kind", "key", given_.alias("open")).agg(F.count("*").alias("n_names")), "keys")
    linked = connected_components(_typos(nodes), at_once=1_000_000).withColumnRenamed("component", "party")
    known = cut(nodes.join(linked, "node", "left").withColumn("party", F.coalesce("party", "node")), "parties")

    # A name read both ways goes where it meets most names.
    sizes = known.groupBy("party").agg(F.sum("n_names").alias("met"))
    placed = marked.select("name", "kind", "node").join(known.select("node", "party"), "node").join(sizes, "party")
    first = placed.groupBy("name").agg(F.max_by("party", F.struct("met", (F.col("kind") == "P").cast("int"), -F.col("party"))).alias("party"))

    # The forms that full names make: given name and initial with the surname, acronyms; then bare surnames.
    people = known.where("kind = 'P'")
    made = people.select(
        F.explode(F.array(F.concat_ws("|", F.lit("P"), "open", "key"), F.concat_ws("|", F.lit("I"), F.substring("open", 1, 1), "key"))).alias("form"),
        "party", F.col("n_names").alias("n"),
    )
    spelled = marked.where("kind = 'O' AND open <> ''").groupBy("node", "open").agg(F.count("*").alias("n")).join(known.select("node", "party"), "node")
    made = made.unionByName(spelled.select(F.concat(F.lit("A|"), "open").alias("form"), "party", "n"))
    partly = parsed.where((F.col("kind").isin("I", "A")) | ((F.col("kind") == "P") & several))
    forms_ = F.when(F.col("kind") == "A", F.array(F.concat(F.lit("A|"), "key"))).when(F.col("kind") == "I", F.array(F.concat_ws("|", F.lit("I"), "open", "key"))).otherwise(
        F.transform(F.split("open", "[|]"), lambda x: F.concat_ws("|", F.lit("P"), x, F.col("key")))
    )
    settled = cut(_settle(partly.select("name", F.concat_ws("|", "kind", "key", "open").alias("asked"), forms_.alias("forms")), made), "settled")

    # Open names that met none are parties of their own, and make surnames too.
    left = partly.where("kind <> 'A'").join(settled, "name", "left_anti").select("name", "kind", "key", "open", _number(F.lit("I"), F.col("key"), F.col("open")).alias("party"))
    left = cut(left, "left")
    surnames = people.select("key", "party", F.col("n_names").alias("n")).unionByName(left.groupBy("key", "party").agg(F.count("*").alias("n")))
    bare = parsed.where("kind = 'S'").select("name", "key")
    exact = cut(_settle(bare.select("name", F.col("key").alias("asked"), F.array("key").alias("forms")), surnames.withColumnRenamed("key", "form")), "by-surname")

    # A misspelt surname that no full name has, bare or with an initial, by the forms with a letter left out.
    def shorter(batches):
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "short": [sorted(shortened(k)) for k in batch["key"]]})

    keys = people.select("key").distinct()
    lost = bare.select("name", "key", F.lit("").alias("initial")).unionByName(left.where("kind = 'I'").select("name", "key", F.col("open").alias("initial")))
    lost = lost.join(exact, "name", "left_anti").join(keys, "key", "left_anti")
    lost = lost.join(lost.select("key").distinct().mapInPandas(shorter, "key string, short array<string>"), "key")
    forms_ = F.transform("short", lambda x: F.concat_ws("|", F.col("initial"), x))
    theirs = people.join(keys.mapInPandas(shorter, "key string, short array<string>"), "key").select("open", F.explode("short").alias("short"), "party", F.col("n_names").alias("n"))
    theirs = theirs.select(F.explode(F.array(F.lit(""), F.substring("open", 1, 1))).alias("initial"), "short", "party", "n")
    by_typo = _settle(lost.select("name", F.concat_ws("|", "initial", "key").alias("asked"), forms_.alias("forms")), theirs.select(F.concat_ws("|", "initial", "short").alias("form"), "party", "n"))
    steps = (first, settled, exact, by_typo, left.select("name", "party"))
    ranked = [df.select("name", "party", F.lit(k).alias("step")) for k, df in enumerate(steps)]
    found = ranked[0]
    for df in ranked[1:]:
        found = found.unionByName(df)
    return found.groupBy("name").agg(F.min_by("party", F.struct("step", "party")).alias("party"))


def pairs(found: DataFrame) -> DataFrame:
    """``name_a, name_b``: all pairs of names of one party."""
    found = cut(found, "found")
    left, right = found.withColumnRenamed("name", "name_a"), found.withColumnRenamed("name", "name_b")
    return left.join(right, "party").where("name_a < name_b").select("name_a", "name_b")
