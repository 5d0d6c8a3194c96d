"""The best representative of each group of duplicate records.

Finding the groups: surnames are joined by the pigeonhole segment join; of two records with close
names, date of birth, height and weight decide. Choosing the record: token-level consensus. The
values of a field are aligned progressively, the weightiest first; tokens are voted on per column with
the weights of their records (trust in the source, completeness, recency), and the existing value
closest to the consensus survives. Records that contradict their group's survivor leave the group.

A group is never gathered: distinct values are counted first, aligned ``FAN`` at a time, and the
resulting profiles merged in further rounds, so that a group that holds a third of all records is
many partial sums and small alignments.

Defined results: a record without duplicates is its own group and survives as it is; null values
have no vote; of equally close values the weightier, then the smaller one survives; placeholders
(the id 1) stay alone.
"""

from __future__ import annotations

import json
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.components import components
from fieldmark.llm.names import name_likeness, near_surnames, surnames
from fieldmark.plans.lineage import cut

#: Trust in the sources of player records.
TRUST = {"club": 3.0, "afl-tables": 2.0, "footywire": 1.0}
#: Most differences of one person's records.
MOST_CM, MOST_KG = 4, 8
TEXT_FIELDS = ("first_name", "surname", "external_id", "external_afl_player_id", "date_of_birth")
NUMBER_FIELDS = ("height_cm", "weight_kg", "is_retired", "legacy_is_retired")
#: Values aligned at a time, and likeness from which tokens share a column.
FAN, LEAST_LIKE = 32, 0.3


def _near(a: Column, b: Column, most: int) -> Column:
    return F.coalesce(F.abs(a - b) <= most, F.lit(True))


def _birth(a: Column, b: Column) -> Column:
    """3 where two dates of birth agree, swapped day and month too; 2 where the first of January of
    the same year stands for one of them, 1 where one is unknown, 0 where they differ."""
    swapped = F.concat(F.substring(a, 1, 4), F.lit("-"), F.substring(a, 9, 2), F.lit("-"), F.substring(a, 6, 2))
    filler = (F.substring(a, 1, 4) == F.substring(b, 1, 4)) & (F.endswith(a, F.lit("-01-01")) | F.endswith(b, F.lit("-01-01")))
    return F.when(a.isNull() | b.isNull(), 1).when((a == b) | (swapped == b), 3).when(filler, 2).otherwise(0)


def _agrees(like: Column, birth: Column, heights: tuple[Column, Column], weights: tuple[Column, Column]) -> Column:
    """Whether two records with close names are one person's. An agreeing birth date carries an initial;
    a year alone a whole name, or an initial and a measure; without a date the name must be whole, and
    a measure agree unless there is none to compare and the surname is the same."""
    measured = heights[0].isNotNull() & heights[1].isNotNull() | weights[0].isNotNull() & weights[1].isNotNull()
    whole, same = (like >= 20) & (like % 10 >= 2), like % 10 == 3
    near = _near(*heights, MOST_CM) & _near(*weights, MOST_KG)
    return (like > 0) & near & ((birth == 3) | (birth == 2) & (whole | same & measured) | (birth == 1) & whole & (measured | same))


def duplicate_links(players: DataFrame) -> DataFrame:
    """(a, b): pairs of player ids that are one person's, the smaller first.

    Records meet on a close surname and on a birth date that agrees; where a date is a filler, on its
    year; where it is unknown, on a measure, or on the same surname where none can be compared: a
    frequent surname alone brings no records with a date and measures together.
    """
    p = players.where("id <> 1").select("id", F.concat_ws(" ", F.concat("surname", F.lit(",")), "first_name").alias("name"), F.nullif("date_of_birth", F.lit("")).alias("dob"), "height_cm", "weight_kg").dropDuplicates(["id"])
    p = cut(p.withColumn("s", F.explode(surnames(F.col("name")))))
    texts = p.select(F.col("s").alias("text"))
    near = cut(near_surnames(texts, texts))
    # a birth date with day and month in either order
    born = F.concat_ws("-", F.substring("dob", 1, 4), F.least(F.substring("dob", 6, 2), F.substring("dob", 9, 2)), F.greatest(F.substring("dob", 6, 2), F.substring("dob", 9, 2)))
    unknown, filler = F.col("dob").isNull(), F.endswith("dob", F.lit("-01-01"))
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    cm, kg = F.col("height_cm").isNotNull(), F.col("weight_kg").isNotNull()

    def keys(vague: bool) -> Column:
        """What a record with a vague date and another one meet on, from either side."""
        around = F.sequence(F.lit(-1), F.lit(1)) if vague else F.array(F.lit(0))
        step = lambda kind, c, most: F.transform(around, lambda d: F.when(F.col(c).isNotNull() & (unknown if vague else F.lit(True)), key(kind, F.floor(F.col(c) / (most + 1)) + d)))
        # a pair without a measure in common: one has none at all, or each has another one
        bare = F.array(F.when(unknown, key("any", F.lit(1))).otherwise(None), F.when(unknown & ~cm & ~kg, key("all", F.lit(1))), F.when(unknown & cm & ~kg, key("only", F.lit("kg"))), F.when(unknown & kg & ~cm, key("only", F.lit("cm"))))
        other = F.array(F.when(~cm & ~kg, key("any", F.lit(1))), key("all", F.lit(1)), F.when(kg & ~cm, key("only", F.lit("kg"))), F.when(cm & ~kg, key("only", F.lit("cm"))))
        year = F.array(F.when((filler if vague else F.lit(True)) & ~unknown, key("year", F.substring("dob", 1, 4))))
        return F.explode(F.array_compact(F.concat(step("height", "height_cm", MOST_CM), step("weight", "weight_kg", MOST_KG), year, bare if vague else other)))

    l_ = p.join(near, F.col("s") == F.col("left")).drop("left")
    named = lambda df, side, *more: df.select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "name", "dob", "height_cm", "weight_kg")], *more)
    dated = named(l_.where(~unknown), "l", F.col("right").alias("s"), born.alias("key")).join(named(p.where(~unknown), "r", "s", born.alias("key")), ["s", "key"])
    same = F.col("own") | ~F.col("key.kind").isin("any", "all", "only")
    open_ = named(l_.where(unknown | filler), "l", F.col("right").alias("s"), (F.col("s") == F.col("right")).alias("own"), keys(True).alias("key")).where(same).join(named(p, "r", "s", keys(False).alias("key")), ["s", "key"])
    pairs = dated.drop("s", "key").unionByName(open_.drop("s", "key", "own")).where("l_id <> r_id")
    # either record may be the vague one: pairs are put in the order of their ids
    turned = lambda side, other: F.when(F.col("l_id") < F.col("r_id"), F.struct(*[F.col(f"{side}_{c}").alias(c) for c in ("id", "name", "dob", "height_cm", "weight_kg")])).otherwise(F.struct(*[F.col(f"{other}_{c}").alias(c) for c in ("id", "name", "dob", "height_cm", "weight_kg")]))
    pairs = pairs.select(turned("l", "r").alias("l"), turned("r", "l").alias("r")).distinct()
    heights, weights = ((F.col(f"l.{c}"), F.col(f"r.{c}")) for c in ("height_cm", "weight_kg"))
    pairs = pairs.withColumn("birth", _birth(F.col("l.dob"), F.col("r.dob"))).where((F.col("birth") > 0) & _near(*heights, MOST_CM) & _near(*weights, MOST_KG))
    scored = cut(pairs).withColumn("like", name_likeness(F.col("l.name"), F.col("r.name")))
    return scored.where(_agrees(F.col("like"), F.col("birth"), heights, weights)).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def persons(players: DataFrame) -> DataFrame:
    """(player_id, person_id) of every player id; the person's id is its smallest."""
    found = components(duplicate_links(players))
    ids = players.select(F.col("id").alias("player_id")).distinct()
    return ids.join(found, F.col("player_id") == F.col("node"), "left").select("player_id", F.coalesce("component", "player_id").alias("person_id"))


def p5_found(confirmed: DataFrame) -> DataFrame:
    """(canonical_id, retired_id) of ``confirmed``, the people that their survivors confirm."""
    return confirmed.where("player_id <> person_id").select(F.col("person_id").alias("canonical_id"), F.col("player_id").alias("retired_id")).distinct()


PROFILE = "array<array<struct<token:string,weight:double>>>"


def _merge(a: list[dict[str, float]], b: list[dict[str, float]]) -> list[dict[str, float]]:
    """Two profiles (columns of weighted tokens) aligned into one, by the order-keeping matching of their
    columns with the likest tokens; columns without a partner stay on their own."""
    n, m = len(a), len(b)

    def like(x: dict[str, float], y: dict[str, float]) -> float:
        got = sum(v * w * (1.0 if s == t else SequenceMatcher(None, s.lower(), t.lower()).ratio()) for s, v in x.items() for t, w in y.items())
        return got / max(sum(x.values()) * sum(y.values()), 1e-300)

    score = [[like(x, y) for y in b] for x in a]
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + score[i][j] if score[i][j] >= LEAST_LIKE else 0.0)
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and score[i][j] >= LEAST_LIKE and best[i][j] == best[i + 1][j + 1] + score[i][j]:
            both = dict(a[i])
            for t, w in b[j].items():
                both[t] = both.get(t, 0.0) + w
            out.append(both)
            i, j = i + 1, j + 1
        elif i < n and (j == m or best[i][j] == best[i + 1][j]):
            out.append(a[i])
            i += 1
        else:
            out.append(b[j])
            j += 1
    return out


def _progressive(profiles: Column) -> Column:
    """One profile of an array of profiles, as JSON: the weightiest first, each next one aligned to the result."""

    @F.pandas_udf("string")
    def merged(groups: pd.Series) -> pd.Series:
        out = []
        for group in groups:
            plain = [[{t["token"]: t["weight"] for t in column} for column in json.loads(profile)] for profile in group]
            plain.sort(key=lambda p: (-max((sum(c.values()) for c in p), default=0.0), [sorted(c) for c in p]))
            whole = plain[0]
            for profile in plain[1:]:
                whole = _merge(whole, profile)
            out.append(json.dumps([[{"token": t, "weight": w} for t, w in sorted(c.items())] for c in whole]))
        return pd.Series(out)

    return merged(profiles)


def _tokens(value: Column) -> Column:
    return F.filter(F.split(F.trim(value), r"[\s\-]+"), lambda t: t != "")


def consensus(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value): of ``values(keys, value, weight)`` the existing value closest to the token-level
    consensus of each group. Distinct values are aligned progressively, FAN at a time: their profiles
    are merged in turn, so that no task holds more than about FAN of a group."""
    tally = cut(values.where("value is not null").groupBy(*keys, "value").agg(F.sum("weight").alias("weight")))
    sizes = tally.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("weight").alias("total"))
    alone = tally.join(sizes.where("n = 1").select(*keys), keys).select(*keys, "value")
    several = cut(tally.join(sizes.where("n > 1"), keys))
    most = several.agg(F.max("n")).first()[0] or 0
    if not most:
        return alone
    level = several.select(*keys, "n", "total", F.xxhash64("value").alias("h"), F.to_json(F.transform(_tokens(F.col("value")), lambda t: F.array(F.struct(t.alias("token"), F.col("weight").alias("weight"))))).alias("profile"))
    while True:
        blocks = F.ceil(F.col("n") / FAN)
        merged = level.groupBy(*keys, "n", "total", F.pmod("h", blocks).alias("h")).agg(F.collect_list("profile").alias("profiles"))
        level = cut(merged.select(*keys, blocks.alias("n"), "total", "h", _progressive(F.col("profiles")).alias("profile")))
        most = -(-most // FAN)
        if most <= 1:
            break
    level = level.withColumn("profile", F.from_json("profile", PROFILE))
    # a column is kept where tokens outweigh gaps, with its weightiest token
    voted = F.transform("profile", lambda c: F.struct(F.aggregate(c, F.lit(0.0), lambda acc, t: acc + t["weight"]).alias("all"), F.array_max(F.transform(c, lambda t: F.struct(t["weight"].alias("weight"), t["token"].alias("token"))))["token"].alias("token")))
    wanted = level.select(*keys, F.transform(F.filter(voted, lambda c: c["all"] * 2 >= F.col("total")), lambda c: c["token"]).alias("wanted"))
    scored = several.join(wanted, keys).withColumn("edits", F.levenshtein(F.concat_ws(" ", _tokens(F.col("value"))), F.concat_ws(" ", "wanted")))
    return scored.groupBy(*keys).agg(F.min_by("value", F.struct("edits", -F.col("weight"), "value")).alias("value")).unionByName(alone)


def survivors(players: DataFrame, people: DataFrame) -> DataFrame:
    """One record a person: person_id, records, for each field the surviving value, the source of the
    weightiest record and the latest update. A person with one record keeps it as it is."""
    sizes = people.groupBy("person_id").agg(F.count("*").alias("records"))
    fields = (*TEXT_FIELDS, *NUMBER_FIELDS)
    records = players.select("id", "record_source", "updated_at", *fields).dropDuplicates(["id"]).join(people, F.col("id") == F.col("player_id")).join(sizes, "person_id")
    records = records.select("person_id", "records", "record_source", "updated_at", *fields)
    trust = F.coalesce(F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv])[F.col("record_source")], F.lit(0.5))
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("double") for c in fields]) / len(fields)
    # up to one point for recency: half of it for each three years of age before the data's last update
    several = cut(records.where("records > 1"))
    last = several.agg(F.max(F.unix_timestamp("updated_at"))).first()[0]
    age = F.coalesce((F.lit(last).cast("long") - F.unix_timestamp("updated_at")) / (3 * 365.25 * 86400), F.lit(9.0))
    weighted = several.withColumn("weight", trust + filled + F.pow(F.lit(0.5), age))
    long = weighted.select("person_id", "weight", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), F.lit(c in TEXT_FIELDS).alias("is_text")) for c in fields])).alias("f")).select("person_id", "weight", "f.*")
    # a filler date of birth yields to any other
    long = long.withColumn("weight", F.when((F.col("field") == "date_of_birth") & F.endswith(F.col("value"), F.lit("-01-01")), F.col("weight") / 100).otherwise(F.col("weight")))
    # an initial or capitals throughout are no better spelling than the name they stand for
    name = F.col("field").isin("first_name", "surname")
    long = long.withColumn("weight", F.when(name & F.col("value").rlike(r"^\S\.?$"), F.col("weight") / 100).when(name & (F.upper("value") == F.col("value")), F.col("weight") / 10).otherwise(F.col("weight")))
    chosen = consensus(long.where("is_text"), ["person_id", "field"])
    voted = long.where("not is_text AND value is not null").groupBy("person_id", "field", "value").agg(F.sum("weight").alias("w")).groupBy("person_id", "field").agg(F.max_by("value", F.struct("w", "value")).alias("value"))
    wide = chosen.unionByName(voted).groupBy("person_id").pivot("field", list(fields)).agg(F.first("value"))
    from_ = weighted.groupBy("person_id").agg(F.max("records").alias("records"), F.max_by("record_source", F.struct("weight", "record_source")).alias("record_source"), F.max("updated_at").alias("updated_at"))
    whole = from_.join(wide, "person_id", "left").select("person_id", "records", *TEXT_FIELDS, *[F.col(c).cast("int").alias(c) for c in NUMBER_FIELDS], "record_source", "updated_at")
    single = records.where("records = 1").select("person_id", "records", *TEXT_FIELDS, *[F.col(c).cast("int").alias(c) for c in NUMBER_FIELDS], "record_source", "updated_at")
    return single.unionByName(whole)


def confirm(players: DataFrame, people: DataFrame) -> DataFrame:
    """(player_id, person_id): ``people`` without the members whose record contradicts their group's
    surviving record, as chains of links may join. Members that leave a group are a group of their own,
    which is confirmed in turn; a record alone confirms itself. A person's id is the smallest confirmed one."""
    fields = (*TEXT_FIELDS, *NUMBER_FIELDS)
    p = players.select(F.col("id").alias("player_id"), *fields).dropDuplicates(["player_id"])
    record = F.struct(F.concat_ws(" ", F.concat("surname", F.lit(",")), "first_name").alias("name"), F.nullif("date_of_birth", F.lit("")).alias("dob"), F.col("height_cm").alias("cm"), F.col("weight_kg").alias("kg"))
    several = people.groupBy("person_id").agg(F.count("*").alias("n")).where("n > 1").select("person_id")
    left, parts = cut(people.join(several, "person_id").select("player_id", "person_id")), [people.join(several, "person_id", "left_anti").select("player_id", "person_id")]
    while not left.isEmpty():
        chosen = survivors(players, left)
        c = chosen.where("records > 1").select("person_id", *[F.col(c).alias(f"c_{c}") for c in fields])
        same = reduce(lambda x, y: x + y, [F.coalesce((F.col(f) == F.col(f"c_{f}")).cast("int"), F.lit(0)) for f in fields])
        m = cut(left.join(p, "player_id").join(c, "person_id").select("player_id", "person_id", record.alias("m"), same.alias("same")))
        # the existing record closest to the consensus speaks for the group: a mixture of two persons' values speaks for neither
        centre = m.groupBy("person_id").agg(F.max_by("m", F.struct("same", -F.col("player_id"))).alias("c"))
        m = m.join(centre, "person_id").withColumns({"like": name_likeness(F.col("m.name"), F.col("c.name")), "birth": _birth(F.col("m.dob"), F.col("c.dob"))})
        fits = F.col("m").eqNullSafe(F.col("c")) | (F.col("like") > 0) & (F.col("birth") > 0) & _near(F.col("m.cm"), F.col("c.cm"), MOST_CM) & _near(F.col("m.kg"), F.col("c.kg"), MOST_KG)
        marked = cut(left.join(m.select("player_id", fits.alias("fits")), "player_id", "left").withColumn("fits", F.coalesce("fits", F.lit(True))))
        sizes = marked.groupBy("person_id").agg(F.count_if(~F.col("fits")).alias("out"), F.min(F.when(F.col("fits"), F.col("player_id"))).alias("first"), F.min(F.when(~F.col("fits"), F.col("player_id"))).alias("next"))
        split = marked.join(sizes.where("out > 0"), "person_id")
        parts.append(marked.join(sizes.where("out > 0").select("person_id"), "person_id", "left_anti").select("player_id", "person_id").unionByName(split.where("fits").select("player_id", F.col("first").alias("person_id"))))
        left = cut(split.where("NOT fits").select("player_id", F.col("next").alias("person_id")))
    return reduce(DataFrame.unionByName, parts)


def repointed(rows: DataFrame, people: DataFrame) -> DataFrame:
    """``rows`` with the person's id for ``player_id``. Rows of unknown ids stay as they are."""
    to = people.select(F.col("player_id").alias("_player"), F.col("person_id").alias("_person"))
    return rows.join(to, F.col("player_id") == F.col("_player"), "left").withColumn("player_id", F.coalesce("_person", "player_id")).drop("_player", "_person")
