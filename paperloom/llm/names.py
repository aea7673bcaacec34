"""Problem 7: variant spellings of the names of people and groups.

Whole names become weighted character-trigram vectors, and the cosine of two vectors is
their similarity: it is thresholded, and average linkage groups the names by it, run as
rounds of merging mutual nearest neighbours. Rules about families, given names and suffixes
only veto. Pairs are found by a distributed sparse cosine join of the family parts over
their rarest trigrams, beside an exact join of families one edit apart, and meet by keys of
the given name, so that no common family or given name is paired with all of its own.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.multivalue import split_names
from paperloom.runtime import attach, release, ship, spread_join, store

#: Least cosine of two whole names, of two family forms in their join, and least average of two clusters that merge.
COSINE, FAMILY_COSINE, LINKAGE = 0.2, 0.5, 0.1
#: What a pair of names that a rule parts, or that is not alike, counts in an average.
UNLINKED = -0.5
GRAM = 3
#: Floor of a trigram's document share: it bounds the weights of rare trigrams, so that cosines
#: settle as the collection grows.
FLOOR = 0.01
#: Weight of a given name's trigrams, those of families having 1.
GIVEN = 0.5
#: Family forms shorter than this must be equal; longer ones may differ by an edit for every
#: ``PER_EDIT`` letters, one at least. ``TWICE`` letters make two edits bearable.
EDITABLE, PER_EDIT, TWICE = 4, 8, 8
#: Letters that are one in an edit count, as transliterations swap them.
ALIKE = str.maketrans("wyz", "vis")
#: A given name of so few letters may abbreviate another.
SHORT = 3
#: Names of one family beyond which they meet by keys of the given name, not all of them.
MANY = 64
#: Rows of one key beyond which a join spreads it over several tasks.
HOT_ROWS = 20_000

# Short forms and the given names they stand for.
NICKNAMES = {
    "abby": "abigail", "al": "albert alan alfred", "alex": "alexander alexandra", "andy": "andrew", "angie": "angela", "annie": "anne",
    "barb": "barbara", "bart": "bartholomew", "becky": "rebecca", "bella": "isabella", "ben": "benjamin", "beppe": "giuseppe", "bert": "albert robert",
    "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine",
    "charlie": "charles", "chris": "christopher christian christine", "chuck": "charles", "cindy": "cynthia", "dan": "daniel", "danny": "daniel",
    "dave": "david", "debbie": "deborah", "dick": "richard", "dima": "dmitri", "don": "donald", "drew": "andrew", "ed": "edward", "eddie": "edward",
    "ellie": "eleanor", "fran": "francisco frances", "frank": "francis", "fred": "frederick", "gabi": "gabriella", "greg": "gregory", "gus": "gustav",
    "hal": "henry harold", "hank": "henry", "hans": "johannes", "harry": "henry harold", "jack": "john", "jake": "jacob", "jan": "johannes", "jeff": "jeffrey",
    "jen": "jennifer", "jenny": "jennifer", "jerry": "gerald", "jim": "james", "jimmy": "james", "joe": "joseph", "jon": "jonathan", "josh": "joshua",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth", "kit": "christopher katherine", "kolya": "nikolai", "larry": "lawrence",
    "len": "leonard", "liz": "elizabeth", "lou": "louis louise", "maggie": "margaret", "mandy": "amanda", "marge": "margaret", "matt": "matthew",
    "max": "maximilian", "meg": "margaret", "mike": "michael", "misha": "michael mikhail", "mitch": "mitchell", "nancy": "anne", "nat": "nathaniel",
    "nell": "eleanor", "nick": "nicholas nikolai", "nico": "nicholas nikolai", "paco": "francisco", "pam": "pamela", "pancho": "francisco", "pat": "patrick patricia",
    "peggy": "margaret", "pepe": "jose giuseppe", "pete": "peter", "phil": "philip", "ray": "raymond", "rick": "richard", "rob": "robert", "ron": "ronald",
    "sam": "samuel samantha", "sandy": "alexander", "sandra": "alexandra", "sasha": "alexander alexandra", "seb": "sebastian", "steve": "stephen steven", "sue": "susanna susan",
    "susie": "susanna susan", "ted": "theodore edward", "theo": "theodore", "tim": "timothy", "tina": "valentina christina", "toby": "tobias", "tom": "thomas",
    "tommy": "thomas", "tony": "anthony", "valya": "valentina", "vic": "victor", "vicky": "victoria", "walt": "walter", "will": "william", "zach": "zachary",
}
_PARTICLES = set("van von der den de del della di da dos das du la le el al bin ibn ter ten zu zur".split())
_TITLE = re.compile(r"^(?:(?:(?:Dr|Prof|Professor|Mr|Mrs|Ms|Sir)\b\.?|(?:DR|PROF)\.)\s+)+")
_SUFFIX = re.compile(r"(?:,\s*|\s+)(?:((?i:jr|sr))\.?|(II|III|IV))(?=\s*(?:,|$))")
_GROUP = re.compile(r"(?i)\b(?:collaboration|collab\.?|coll\.?|consortium|group|team)(?=\s|$)")
_PLAIN = {"ß": "ss", "ø": "o", "ł": "l", "æ": "ae", "œ": "oe", "đ": "d", "ı": "i"}


def fold(s: str) -> str:
    """Lower case without accents."""
    s = unicodedata.normalize("NFD", s.lower())
    return "".join(_PLAIN.get(c, c) for c in s if not unicodedata.combining(c))


def _family(words: list[str]) -> str:
    kept = [w for w in (re.sub(r"[^\w]", "", fold(x)) for x in words)]
    return "".join([w for w in kept if w not in _PARTICLES] or kept)


def _given(words: list[str], shouting: bool) -> list[str]:
    """Given names and initials, folded; ``MT`` and ``M.T.`` are two initials."""
    out: list[str] = []
    for w in words:
        for x in re.findall(r"[^\W\d_]+\.?", w.replace("'", "").replace("’", "")) if "." in w else [w.replace("-", "")]:
            bare = x.rstrip(".")
            if not bare:
                continue
            if bare.isupper() and 1 < len(bare) <= 3 and not shouting and "." not in x:
                out += list(fold(bare))
            else:
                out.append(re.sub(r"[^\w]", "", fold(bare)))
    return [w for w in out if w and w not in _PARTICLES]


def read_name(name: str) -> list[tuple[str, str, str, str, bool]]:
    """Readings (kind, family, given, suffix, first) of a name; ``given`` is space-joined.

    Two full words without a comma may be in either order, so they have a second reading
    with ``first`` false. A name without letters has none.
    """
    text = _TITLE.sub("", re.sub(r"\s+", " ", name).strip())
    if _GROUP.search(text):
        core = re.sub(r"^the ", "", _GROUP.sub(" ", text).strip(" .,"), flags=re.I)
        f = re.sub(r"[^\w]", "", fold(core))
        return [("g", f, "", "", True)] if f else []
    m = _SUFFIX.search(text)
    suffix = (m[1] or m[2]).lower() if m else ""
    if m:
        text = (text[: m.start()] + text[m.end():]).strip(" ,")
    shouting = text.upper() == text
    if "," in text:
        left, right = text.split(",", 1)
        f, g = _family(left.split()), _given(right.replace(",", " ").split(), shouting)
        return [("p", f, " ".join(g), suffix, True)] if f else []
    words = text.split()
    if not words:
        return []
    if len(words) == 1:
        f = _family(words)
        return [("p", f, "", suffix, True)] if f else []

    def is_initial(w: str) -> bool:
        bare = re.sub(r"[^\w]", "", w)
        return len(bare) == 1 or "." in w[:-1] or (w.endswith(".") and len(bare) <= 2) or (len(bare) == 2 and bare.isupper() and not shouting)

    if is_initial(words[-1]) and not is_initial(words[0]):  # family first, then initials
        at = next((i + 1 for i, w in enumerate(words) if fold(w) not in _PARTICLES), 1)
        f = _family(words[:at])
        return [("p", f, " ".join(_given(words[at:], shouting)), suffix, True)] if f else []
    at = next((i for i, w in enumerate(words) if i and fold(w) in _PARTICLES), len(words) - 1)
    if fold(words[0]) in _PARTICLES and len(words) > 2:  # family first with particles
        at = next((i for i, w in enumerate(words) if fold(w) not in _PARTICLES), 0)
        f = _family(words[: at + 1])
        return [("p", f, " ".join(_given(words[at + 1:], shouting)), suffix, True)] if f else []
    f, g = _family(words[at:]), " ".join(_given(words[:at], shouting))
    out = [("p", f, g, suffix, True)] if f else []
    if f and len(words) == 2 and not is_initial(words[0]):
        f2, g2 = _family(words[:1]), " ".join(_given(words[1:], shouting))
        if f2:
            out.append(("p", f2, g2, suffix, False))
    return out


def edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words;
    ``most + 1`` if there are more than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, before, row = before, row, [i + 1]
        for j, y in enumerate(b):
            d = min(before[j + 1] + 1, row[j] + 1, before[j] + (x != y))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                d = min(d, last[j - 1] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _formal(g: str) -> set[str]:
    return {g, *NICKNAMES.get(g, "").split()}


def _shorter(w: str) -> set[str]:
    """A word and its forms with one letter left out: two words one edit apart share one."""
    return {w} | {w[:i] + w[i + 1:] for i in range(len(w))}


def given_keys(given: str) -> tuple[list[str], list[str], bool]:
    """Keys of a given name: those under which full names meet, the initials under which it
    meets short ones, and whether it is short itself. Second letters are initials too, for a
    first letter that was dropped, changed or swapped: names an edit apart share one."""
    first = given.split(" ")[0]
    if not first:
        return [""], [], False
    forms = _formal(first)
    short = len(first) <= SHORT
    fine = set().union(*(_shorter(f) if len(f) > SHORT else {f} for f in forms))
    return sorted(fine), sorted({f[0] for f in forms} | (set() if short else {f[1] for f in forms if len(f) > 1})), short


def may_be_one(a: tuple[str, str, str, str], b: tuple[str, str, str, str]) -> int:
    """Whether no rule forbids that two readings (kind, family, given, suffix) name one
    entity: 2 if so, 0 if one does, 1 if only the family forms are an edit too far apart.

    Kinds and suffixes must agree; families may differ by some edits, by their length; given
    names, if both are there, must be the same, forms or short forms of one another, one edit
    apart, or an initial of the other, and second given names must begin alike. A name
    without given names is only like such names of its family.
    """
    if a[0] != b[0] or a[3] != b[3]:
        return 0
    f = edits(a[1], b[1])
    least = min(len(a[1]), len(b[1]))
    if f == 2 and least >= TWICE:
        f = min(f, edits(a[1].translate(ALIKE), b[1].translate(ALIKE)))
    if f > 2 or (f and least < EDITABLE) or (f > 1 and least < TWICE):
        return 0
    found = 2 if f <= max(1, least // PER_EDIT) else 1
    if a[0] == "g":
        return found
    ga, gb = a[2].split(), b[2].split()
    if not ga or not gb:
        return found if not f and ga == gb else 0
    x, y = ga[0], gb[0]
    if not _formal(x) & _formal(y):
        if len(x) == 1 or len(y) == 1:
            if not {w[0] for w in _formal(x)} & {w[0] for w in _formal(y)}:
                return 0
        elif not _abbreviates(x, y) and (
                min(len(x), len(y)) <= SHORT or min(edits(p, q, 1) for p in _formal(x) for q in _formal(y)) > 1):
            return 0
    return 0 if len(ga) > 1 and len(gb) > 1 and ga[1][0] != gb[1][0] else found


def _abbreviates(x: str, y: str) -> bool:
    """Whether the shorter, of at most ``SHORT`` letters and no vowel but a first one, is the
    other's first letter and later ones in order, such as ``wm`` of ``william``."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) > SHORT or len(x) == len(y) or x[0] != y[0] or any(c in "aeiouy" for c in x[1:]):
        return False
    rest = iter(y[1:])
    return all(c in rest for c in x[1:])


def _read_batches(batches):
    for b in batches:
        rows = [(n, *r) for n in b.column("name").to_pylist() for r in read_name(n)]
        cols = list(zip(*rows)) if rows else [[] for _ in range(6)]
        keys = list(zip(*(given_keys(g) for g in cols[3]))) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.string()) for c in cols[:5]], pa.array(cols[5], pa.bool_()),
             pa.array(keys[0], pa.list_(pa.string())), pa.array(keys[1], pa.list_(pa.string())), pa.array(keys[2], pa.bool_())],
            ["name", "kind", "family", "given", "suffix", "first", "fine", "initials", "short"])


def readings(names: DataFrame) -> DataFrame:
    """(name, kind, family, given, suffix, first, fine, initials, short) of distinct names."""
    ship(names.sparkSession)
    return names.select("name").mapInArrow(
        _read_batches, "name string, kind string, family string, given string, suffix string, first boolean, "
        "fine array<string>, initials array<string>, short boolean")


def _weighted(grams: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """(keys…, gram, at, w): the weight of each trigram of each item, its count times a bounded
    log of its rarity; ``grams`` is (keys…, gram, pos)."""
    per = grams.groupBy(*keys, "gram").agg(F.count("*").alias("tf"), F.collect_set("pos").alias("at"))
    df = per.groupBy("gram").agg(F.count("*").alias("df"))
    return per.join(df, "gram").withColumn("w", F.col("tf") * F.log1p(1 / (F.col("df") / max(n, 1) + FLOOR)))


def _grams(words: Column, weight: Column) -> Column:
    """Array of (gram, weight) of the padded words."""

    def of(w: Column) -> Column:
        padded = F.concat(F.lit("^"), w, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - GRAM + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.struct(padded.substr(i, F.lit(GRAM)).alias("gram"), weight.alias("weight")))

    return F.flatten(F.transform(F.filter(words, lambda w: w != ""), of))


def name_vectors(read: DataFrame, only: DataFrame) -> DataFrame:
    """(name, vec): unit trigram vectors of the whole names in ``only``, a map from trigram to
    weight. Words are padded each, so the order of the parts is no matter; particles, titles
    and suffixes are not in the readings. A trigram of a given name weighs ``GIVEN``.
    Document counts are those of all names, summed before the shuffle."""
    grams = F.concat(_grams(F.array("family"), F.lit(1.0)), _grams(F.split("given", " "), F.lit(GIVEN)))
    whole = read.filter("first").select("name", grams.alias("g"))
    n = max(whole.count(), 1)
    df = store(whole.select(F.explode(F.array_distinct(F.transform("g", lambda x: x["gram"]))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df")))
    asked = whole.join(only, "name", "left_semi").select("name", F.explode("g").alias("x")).groupBy("name", "x.gram").agg(F.sum("x.weight").alias("tf"))
    weighted = attach(asked, df, "gram", "df").withColumn("w", F.col("tf") * F.log1p(1 / (F.col("df") / n + FLOOR)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"]))
    return weighted.groupBy("name").agg(F.collect_list(F.struct("gram", "w")).alias("v")).select(
        "name", F.map_from_entries(F.transform("v", lambda x: F.struct(x["gram"], x["w"] / norm))).alias("vec"))


def alike_families(families: DataFrame, threshold: float = FAMILY_COSINE) -> DataFrame:
    """(kind, fa, fb, cosine): unequal family forms of at least ``TWICE`` letters, fa < fb, of
    trigram cosine at least ``threshold`` and at most two letter edits apart.

    Two vectors that close must share a trigram among those of each that come before the
    rest's norm falls under the threshold, rarest first. Only those are joined, by trigram
    and place (two edits move the others by two places at most), so common endings are never
    a join key unless nothing rarer is left. The exact cosine is taken of what remains.
    """
    forms = families.select("kind", "family").distinct().filter(F.length("family") >= TWICE)
    padded = F.concat(F.lit("^"), F.col("family"), F.lit("$"))
    places = F.transform(F.sequence(F.lit(1), F.length("family")), lambda i: F.struct(i.alias("pos"), padded.substr(i, F.lit(GRAM)).alias("gram")))
    grams = forms.select("kind", "family", F.explode(places).alias("p")).select("kind", "family", "p.pos", "p.gram")
    vectors = store(
        _weighted(grams, forms.count(), ["kind", "family"])
        .groupBy("kind", "family").agg(F.sort_array(F.collect_list(F.struct("df", "gram", "w", "at"))).alias("v"))
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["w"] * x["w"])))
    )
    # running norm of what comes before each trigram; a trigram is kept while the rest still reaches the threshold
    running = F.aggregate(
        "v", F.struct(F.lit(0.0).alias("s"), F.array().cast("array<struct<gram:string,at:array<int>>>").alias("keep")),
        lambda acc, x: F.struct(
            (acc["s"] + x["w"] * x["w"]).alias("s"),
            F.when(F.sqrt(F.greatest(F.lit(1.0) - acc["s"] / (F.col("norm") * F.col("norm")), F.lit(0.0))) >= threshold - 1e-9,
                   F.concat(acc["keep"], F.array(F.struct(x["gram"].alias("gram"), x["at"].alias("at"))))).otherwise(acc["keep"]).alias("keep")))
    prefix = vectors.select("kind", "family", F.explode(running["keep"]).alias("k")).select(
        "kind", "family", "k.gram", F.explode("k.at").alias("pos"))
    left = prefix.select("kind", "gram", F.col("family").alias("fa"), F.explode(F.sequence(F.col("pos") - 2, F.col("pos") + 2)).alias("pos"))
    right = prefix.withColumnRenamed("family", "fb")
    close = (F.col("fa") < F.col("fb")) & (F.abs(F.length("fa") - F.length("fb")) <= 2) & (F.levenshtein("fa", "fb", 2) >= 0)
    pairs = left.join(right, ["kind", "gram", "pos"]).filter(close).select("kind", "fa", "fb").distinct()
    as_map = F.map_from_entries(F.transform("v", lambda x: F.struct(x["gram"], x["w"] / F.col("norm"))))
    va = vectors.select("kind", F.col("family").alias("fa"), as_map.alias("ma"))
    vb = vectors.select("kind", F.col("family").alias("fb"), as_map.alias("mb"))
    dot = F.aggregate(F.map_entries("ma"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("mb", e["key"]), F.lit(0.0)))
    return pairs.join(va, ["kind", "fa"]).join(vb, ["kind", "fb"]).select("kind", "fa", "fb", dot.alias("cosine")).filter(F.col("cosine") >= threshold)


def one_edit_families(families: DataFrame) -> DataFrame:
    """(kind, fa, fb): family forms of at least ``EDITABLE`` letters, fa < fb, one insertion,
    deletion, substitution or swap of neighbours apart (see ``edits``), or less, letters
    that are ``ALIKE`` being one.

    Two such forms always share a key among themselves and their forms with one letter left
    out, whatever else the corpus holds. A key stands for at most as many forms as letters
    can be put into it, so no key grows with the rows.
    """
    source, to = ("".join(chr(c) for c in x) for x in (ALIKE.keys(), ALIKE.values()))
    forms = families.select("kind", "family").distinct().filter(F.length("family") >= EDITABLE).withColumn("t", F.translate("family", source, to))
    places = F.sequence(F.lit(1), F.length("t"))
    shorter = F.transform(places, lambda i: F.concat(F.substring("t", F.lit(1), i - 1), F.substring("t", i + 1, F.length("t"))))
    keyed = forms.select("kind", "family", "t", F.explode(F.array_distinct(F.concat(F.array("t"), shorter))).alias("key"))
    left, right = (keyed.withColumnRenamed("family", f"f{c}").withColumnRenamed("t", f"t{c}") for c in "ab")
    swapped = lambda i: F.concat(*[F.substring("ta", at, n) for at, n in (
        (F.lit(1), i - 1), (i + 1, F.lit(1)), (i, F.lit(1)), (i + 2, F.length("ta")))])
    swap = (F.length("ta") == F.length("tb")) & F.exists(F.sequence(F.lit(1), F.length("ta") - 1), lambda i: swapped(i) == F.col("tb"))
    close = (F.levenshtein("ta", "tb", 1) >= 0) | swap  # keys also bring together other forms two edits apart
    return left.join(right, ["kind", "key"]).filter((F.col("fa") < F.col("fb")) & close).select("kind", "fa", "fb").distinct()


def _judge(batches):
    for b in batches:
        c = {n: b.column(n).to_pylist() for n in ("kind", "suffix", "fa", "ga", "fb", "gb")}
        ok = pa.array([may_be_one((k, fa, ga, s), (k, fb, gb, s)) for k, s, fa, ga, fb, gb in zip(*c.values())], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), ok], ["a", "b", "ok"])


def candidates(read: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b, near), a < b: pairs of names with an equal or linked family, the same suffix and
    given names that may be one, each pair once; ``near`` is false where only the families
    are too far apart.

    In a family of more than ``MANY`` names full given names meet by their forms with at most
    one letter left out, and short ones meet all with their initial: given names that
    contradict each other do not meet, however common the family is. All that may be one
    share a key, so the plan makes no difference to the pairs. A key with many rows is spread
    over tasks. A second reading only meets first ones.
    """
    both = links.select("kind", F.col("fa").alias("family"), F.col("fb").alias("other")).unionByName(
        links.select("kind", F.col("fb").alias("family"), F.col("fa").alias("other")))
    same = read.withColumn("fb", F.col("family"))
    one = same.unionByName(read.join(both, ["kind", "family"]).withColumnRenamed("other", "fb"))
    one = one.select("kind", "suffix", F.col("name").alias("a"), F.col("family").alias("fa"), F.col("given").alias("ga"), "first", "fine", "initials", "short", "fb")
    other = read.filter("first").select("kind", "suffix", F.col("name").alias("b"), F.col("family").alias("fb"), F.col("given").alias("gb"), "fine", "initials", "short")
    of = ["kind", "suffix", "fb"]
    common = other.groupBy(*of).agg(F.count("*").alias("n")).filter(F.col("n") > MANY).select(*of, F.lit(True).alias("common"))
    tag = lambda c, sign: F.transform(c, lambda k: F.concat(F.lit(sign), k))
    none = F.array().cast("array<string>")

    def keyed(df: DataFrame, short: str, long: str) -> DataFrame:
        letters = "initials" if "initials" in df.columns else "others"
        keys = F.concat(tag("fine", "="), F.when(F.col("short"), tag(letters, short)).otherwise(none), tag(letters, long))
        return df.join(common, of, "left").withColumn("key", F.explode(F.when(F.col("common"), keys).otherwise(F.array(F.lit(""))))).drop(
            "fine", "short", "common")

    left, right = keyed(one, "<", ">"), keyed(other.withColumnRenamed("initials", "others"), ">", "<")
    met = spread_join(right, left, [*of, "key"], HOT_ROWS).filter(
        F.when(F.col("first"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b"))
        & (F.arrays_overlap("initials", "others") | ((F.size("initials") == 0) & (F.size("others") == 0))))  # all that may be one share a letter
    pairs = met.select("kind", "suffix", "a", "fa", "ga", "b", "fb", "gb").distinct()
    judged = pairs.mapInArrow(_judge, "a string, b string, ok int").filter("ok > 0")
    return judged.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg((F.max("ok") == 2).alias("near"))


def name_pairs(read: DataFrame, links: DataFrame, threshold: float = COSINE) -> DataFrame:
    """(a, b, s): the cosine s of the pairs of ``candidates`` that reach the threshold. One
    whose families are too far apart has s 0: it neither links nor parts."""
    met = store(candidates(read, links))
    vec = name_vectors(read, met.select(F.explode(F.array("a", "b")).alias("name")).distinct())
    va, vb = (vec.select(F.col("name").alias(c), F.col("vec").alias(f"v{c}")) for c in "ab")
    dot = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("vb", e["key"]), F.lit(0.0)))
    scored = met.join(va, "a").join(vb, "b").select("a", "b", F.when(F.col("near"), F.round(dot, 9)).otherwise(0.0).alias("s"))
    return scored.filter((F.col("s") >= threshold) | (F.col("s") == 0))


def average_linkage(pairs: DataFrame, threshold: float = LINKAGE, unlinked: float = UNLINKED) -> DataFrame:
    """(name, cluster): average-linkage clusters over (a, b, s); a pair not given counts
    ``unlinked``.

    In each round every pair of clusters that are each other's nearest, by average
    similarity over all their members' pairs, merges if it reaches the threshold. Average
    linkage is reducible, so this gives the tree of one-by-one merging, with all parts of
    the graph advancing together; no component is gathered anywhere. Ties go to the pair
    of smaller names, which makes the nearest pair of all mutual: each round merges some.
    Each round is a written table that replaces the one before.
    """
    links = store(pairs.select("a", "b", "s", F.lit(1).cast("long").alias("m")))
    member = store(links.select(F.explode(F.array("a", "b")).alias("name")).distinct().select("name", F.col("name").alias("cluster")))
    while True:
        sizes = member.groupBy(F.col("cluster").alias("id")).agg(F.count("*").alias("n"))
        cells = F.col("na") * F.col("nb")
        avg = (
            links.join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a")
            .join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
            .withColumn("avg", F.round((F.col("s") + unlinked * (cells - F.col("m"))) / cells, 9)).filter(F.col("avg") >= threshold)
        )
        ends = avg.select("avg", "a", "b", F.explode(F.array("a", "b")).alias("end"))
        nearest = ends.groupBy("end").agg(F.min(F.struct(-F.col("avg"), "a", "b")).alias("m")).select("end", "m.a", "m.b")
        merges = store(nearest.groupBy("a", "b").agg(F.count("*").alias("votes")).filter("votes = 2").select("a", "b"))
        if merges.isEmpty():
            release(links, merges)
            return member
        new = merges.select(F.col("b").alias("id"), F.col("a").alias("to"))
        move = lambda df, c: df.join(new.withColumnRenamed("id", c).withColumnRenamed("to", f"__{c}"), c, "left").withColumn(
            c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
        moved = move(move(links, "a"), "b").filter(F.col("a") != F.col("b"))
        old = links, member, merges
        links = store(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s"), F.sum("m").alias("m")))
        member = store(move(member, "cluster"))
        release(*old)


def author_values(*tables: DataFrame) -> DataFrame:
    """(name): distinct author values of the tables' ``authors``; null, empty and the
    placeholder ``Unknown`` are none."""
    parts = [t.select(F.explode(split_names(F.col("authors"))).alias("name")) for t in tables]
    return reduce(DataFrame.unionByName, parts).filter("name != 'Unknown'").distinct()


def link_names(names: DataFrame, threshold: float = COSINE) -> DataFrame:
    """(cluster, name) of the names that have another spelling; ``cluster`` is the smallest
    spelling. Names are compared as distinct values; empty tables give no rows."""
    read = store(readings(names))
    families = read.select("kind", "family").distinct()
    links = store(alike_families(families).select("kind", "fa", "fb").unionByName(one_edit_families(families)).distinct())
    clusters = average_linkage(name_pairs(read, links, threshold))
    release(links)
    shared = clusters.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster")
    return clusters.join(shared, "cluster", "left_semi").select("cluster", "name")


def spelling_pairs(clusters: DataFrame) -> DataFrame:
    """(name_a, name_b), a before b in byte order: all pairs of spellings of one entity."""
    left = clusters.select("cluster", F.col("name").alias("name_a"))
    right = clusters.select("cluster", F.col("name").alias("name_b"))
    return left.join(right, "cluster").filter(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
