"""Names of persons as typed: readings of a text, and whether two names can be one person's."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.segments import _swaps_as_one, segment_join, spread

# Short forms of given names.
SHORT_FORMS = {
    "abigail": "abby abbie gail", "alexander": "alex sandy alec xander", "alexandra": "alex sandy", "andrew": "andy drew", "angus": "gus", "anthony": "tony ant", "benjamin": "ben benny", "bradley": "brad", "cameron": "cam",
    "charles": "charlie chas chuck", "charlotte": "charlie lottie", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davey", "dominic": "dom nic", "edward": "ed eddie ted ned", "elizabeth": "liz beth lizzie betty eliza libby",
    "frederick": "fred freddie freddy", "gabrielle": "gabby gabi gabe", "gerard": "gerry ger", "gregory": "greg", "henry": "harry hank hal", "imogen": "immy", "isabella": "izzy bella", "jackson": "jack jacko", "james": "jim jimmy jamie", "jessica": "jess jessie",
    "joseph": "joe joey", "joshua": "josh", "katherine": "kate katie kathy kat", "kenneth": "ken kenny", "lachlan": "lachie lochie", "leonard": "len lenny", "madeleine": "maddie maddy", "margaret": "maggie meg peg peggy marg", "matthew": "matt matty",
    "michael": "mick mike mikey", "mitchell": "mitch", "nicholas": "nick nicky", "oliver": "ollie", "patrick": "pat paddy", "peter": "pete", "philippa": "pip pippa", "rebecca": "bec becky", "richard": "rick dick richie rich", "robert": "rob bob robbie bobby",
    "ronald": "ron ronnie", "samantha": "sam sammy sammie", "samuel": "sam sammy sammie", "stephen": "steve", "tarkyn": "tark", "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky tori vic", "william": "will bill billy", "zachary": "zac zach zack",
}
TITLES = frozenset("coach mr mrs ms dr sir".split())


@lru_cache(maxsize=1)
def _long_forms() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for full, shorts in SHORT_FORMS.items():
        for s in (full, *shorts.split()):
            out.setdefault(s, set()).add(full)
    return {k: frozenset(v) for k, v in out.items()}


def plain(text: str | None) -> str:
    """Lower case letters and single blanks; accents, apostrophes and hyphens go."""
    text = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()
    return re.sub(r"[^a-z]+", " ", re.sub(r"['’`-]", "", text)).strip()


def readings(text: str | None) -> list[tuple[str, str]]:
    """(given, surname) pairs that a typed name can stand for, without titles and quoted names. What
    stands before a comma is the surname; without one, either end may be."""
    text = re.sub(r"[\"“(][^\"”)]*[\"”)]", " ", text or "")
    head, comma, tail = text.partition(",")
    if comma and plain(tail):
        return [(_given(plain(tail).split()), plain(head).replace(" ", ""))]
    if comma:
        return [("", plain(head).replace(" ", ""))] if plain(head) else []
    words = [w for w in plain(text).split() if w not in TITLES]
    if not words:
        return []
    if len(words) == 1:
        return [("", words[0])]
    out = [(_given(words[:1] + [w for w in words[1:-1] if len(w) == 1]), "".join(w for w in words[1:] if len(w) > 1) or words[-1])]
    if len(words[0]) > 1:
        out.append((_given(words[-1:]), "".join(w for w in words[:-1] if len(w) > 1)))
    return list(dict.fromkeys((g, s) for g, s in out if s))


@lru_cache(maxsize=50_000)
def _known_readings(text: str | None) -> tuple[tuple[str, str], ...]:
    return tuple(readings(text))


def _given(words: list[str]) -> str:
    """The first given name; initials only where there is nothing longer."""
    return next((w for w in words if len(w) > 1), words[0] if words else "")


#: Letters from which two edits may part surnames, and from which a name may be one part of a double name.
LONG, PART = 6, 6


def surname_edits(a: str, b: str) -> int:
    """0 to 2 edits between surnames that may be one; 9 otherwise."""
    if a == b:
        return 0
    most = 1 if min(len(a), len(b)) < LONG else 2
    d = _swaps_as_one(a, b, most)
    if d <= most:
        return d
    # one part of a double name
    if min(len(a), len(b)) >= PART and (a.startswith(b) or b.startswith(a) or a.endswith(b) or b.endswith(a)):
        return 2
    return 9


@lru_cache(maxsize=100_000)
def given_level(a: str, b: str) -> int:
    """3 the same, 2 a short form or typing error of it, 1 an initial or nothing against a name, 0 another name."""
    if a == b and len(a) > 1:
        return 3
    if not a or not b:
        return 1
    if len(a) == 1 or len(b) == 1:
        longs = _long_forms()
        starts = {x[0] for x in (a, *longs.get(a, ()))} & {x[0] for x in (b, *longs.get(b, ()))}
        return 1 if starts else 0
    longs = _long_forms()
    la, lb = longs.get(a, frozenset()), longs.get(b, frozenset())
    if la & lb and not (a in SHORT_FORMS and b in SHORT_FORMS):
        return 2
    if a in SHORT_FORMS and b in SHORT_FORMS:
        return 0
    if min(len(a), len(b)) >= 3 and (a.startswith(b) or b.startswith(a)):
        return 2
    most = 1 if min(len(a), len(b)) < 7 else 2
    if min(len(a), len(b)) >= 4 and _swaps_as_one(a, b, most) <= most:
        return 2
    # a misspelt short or full form
    for x in (*SHORT_FORMS.get(next(iter(la), ""), "").split(), *la):
        if len(x) >= 4 and min(len(b), len(x)) >= 4 and _swaps_as_one(x, b, 1) <= 1:
            return 2
    for x in (*SHORT_FORMS.get(next(iter(lb), ""), "").split(), *lb):
        if len(x) >= 4 and min(len(a), len(x)) >= 4 and _swaps_as_one(x, a, 1) <= 1:
            return 2
    return 0


def likeness(a: str | None, b: str | None) -> int:
    """0: no one person can have both names; else 10 * given level + 3 - surname edits, the best over all readings."""
    best = 0
    for ga, sa in _known_readings(a):
        for gb, sb in _known_readings(b):
            d = surname_edits(sa, sb)
            if d <= 2 and (g := given_level(ga, gb)):
                best = max(best, 10 * g + 3 - d)
    return best


@lru_cache(maxsize=50_000)
def given_marks(given: str) -> tuple[int, int, int]:
    """Bits of what :func:`given_level` compares besides the letters: the initials that the given name
    may have, its long forms, and the long forms of which it is a form or a misspelt one."""
    longs, numbers = _long_forms().get(given, frozenset()), {full: n for n, full in enumerate(SHORT_FORMS)}
    initials = {x[0] for x in (given, *longs) if x}
    likened = {f for f, shorts in SHORT_FORMS.items() if f in longs or len(given) >= 4 and any(len(x) >= 4 and _swaps_as_one(x, given, 1) <= 1 for x in (f, *shorts.split()))}
    return sum(1 << (ord(c) - 97) for c in initials), sum(1 << numbers[f] for f in longs), sum(1 << numbers[f] for f in likened)


def named(text: Column) -> Column:
    """Array of the readings of a typed name: s, g and the :func:`given_marks` of g."""

    @F.pandas_udf("array<struct<s:string,g:string,initials:bigint,longs:bigint,likened:bigint>>")
    def parts(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("s", "g", "initials", "longs", "likened"), (s, g, *given_marks(g)), strict=True)) for g, s in _known_readings(t)] for t in texts])

    return parts(text)


def may_be_given(a: str, b: str) -> Column:
    """Whether two given names of :func:`named`, the structs ``a`` and ``b``, may be one person's: true wherever
    :func:`given_level` is above 0, and seldom elsewhere. A swap counts as two edits here."""
    return F.expr(f"""{a}.g = {b}.g OR {a}.g = '' OR {b}.g = ''
        OR (length({a}.g) = 1 OR length({b}.g) = 1) AND {a}.initials & {b}.initials <> 0
        OR {a}.longs & {b}.likened <> 0 OR {a}.likened & {b}.longs <> 0
        OR startswith({a}.g, {b}.g) OR startswith({b}.g, {a}.g)
        OR least(length({a}.g), length({b}.g)) >= 4 AND levenshtein({a}.g, {b}.g, IF(least(length({a}.g), length({b}.g)) < 7, 2, 4)) >= 0""")


def near_names(left: DataFrame, right: DataFrame, near: DataFrame) -> DataFrame:
    """(name, other): the names of ``left(name)`` and ``right(name)`` with readings whose surnames are ``near``
    (left, right) and whose given names may be one person's. Holds every pair that :func:`likeness`
    puts above 0. A frequent surname brings together only what may be alike, and only that is left to Python."""
    n, m = (t.select("name", F.explode(named(F.col("name"))).alias("r")) for t in (left, right))
    a = spread(n.select("name", F.col("r").alias("a")).join(near, F.col("a.s") == F.col("left")).select("name", "a", "right"), "right")
    b = spread(m.select(F.col("name").alias("other"), F.col("r").alias("b"), F.col("r.s").alias("right")), "right")
    return a.join(b, "right").where(may_be_given("a", "b")).select("name", "other")


def name_likeness(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[tuple, int] = {}
        out = []
        for p in zip(x, y, strict=True):
            if p not in known:
                known[p] = likeness(*p)
            out.append(known[p])
        return pd.Series(out, dtype="int32")

    return score(a, b)


def surnames(text: Column) -> Column:
    """Array of the surnames of all readings, and the parts of at least six letters of double names."""

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = {s for _, s in readings(t)}
            halves = {plain(h).replace(" ", "") for s in re.split(r"[,\s]", t or "") if "-" in s for h in s.split("-")}
            out.append(sorted(found | {h for h in halves if len(h) >= 6}))
        return pd.Series(out)

    return parts(text)


def near_surnames(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right): every pair of the distinct surnames of ``left(text)`` and ``right(text)`` that
    ``surname_edits`` gives two edits or less, whichever side they stand on."""
    most = lambda n: F.when(n < LONG, 1).otherwise(2)
    # the bound is that of the shorter one, which is no more than that of the right one
    near = segment_join(left, right, most, 2, swaps=True).where(F.col("edits") <= most(F.least(F.length("left"), F.length("right")))).select("left", "right")
    a, b = (t.where("length(text) > 0").select("text").distinct() for t in (left, right))

    def ended(whole: DataFrame) -> DataFrame:
        n = F.length("text")
        ends = F.transform(F.sequence(F.lit(PART), n - 1), lambda k: F.array(F.substring(F.col("text"), F.lit(1), k), F.substring(F.col("text"), n - k + 1, k)))
        return whole.where(n > PART).select("text", F.explode(F.array_distinct(F.flatten(ends))).alias("part"))

    longer = ended(a).join(b.select(F.col("text").alias("part")), "part").select(F.col("text").alias("left"), F.col("part").alias("right"))
    shorter = ended(b).join(a.select(F.col("text").alias("part")), "part").select(F.col("part").alias("left"), F.col("text").alias("right"))
    return near.unionByName(longer).unionByName(shorter).distinct()
