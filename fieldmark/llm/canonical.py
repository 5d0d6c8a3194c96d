"""Free-entered values to the entries of a reference list, unmatched values reported.

Method: every distinct typed token is joined to the reference vocabulary by edit distance
(:mod:`fieldmark.llm.segments`); soft TF-IDF over the repaired tokens ranks whole entries. Adjacent
tokens are also tried as one, on both sides, for blanks typed at the wrong place.

An entry is ranked for a value if the two share one of the entry's heavy tokens, which its lightest ones
without them could not make up for. Work is done once for each distinct value, then joined back, so that a value that a third of all
rows hold costs no more than a rare one.

Defined results: null, empty and filler values, and values of which no token is known, have no
entry (null); of several entries with the same score the smallest id wins; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.segments import segment_join, typing_edits
from fieldmark.plans.lineage import cut

#: Score from which an entry counts as meant, and least similarity of a repaired token.
LEAST_SCORE, LEAST_SIMILARITY = 0.45, 0.6
#: A token that few entries share (weight times similarity, of the most possible) is enough alone.
LEAST_STRONGEST, UNKNOWN = 0.6, 0.6
#: Words of an entry's kind and filler that say nothing about which entry is meant.
PLAIN_WORDS = ("the", "of", "at", "fc", "fnc", "f", "c", "club", "football", "footy", "netball")


def folded(text: Column) -> Column:
    """Lower case, without accents, everything but letters and digits as blanks."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # accents: the letters of the Latin-1 and Latin Extended-A blocks that occur in names
    low = F.translate(low, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżžø", "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzzo")
    return F.trim(F.regexp_replace(F.regexp_replace(low, "['’]", ""), "[^a-z0-9]+", " "))


def _tokens(text: Column) -> Column:
    """Array of (token, parts): single tokens and pairs of adjacent tokens as one."""
    words = F.filter(F.split(text, " "), lambda w: (F.length(w) > 0) & ~w.isin(*PLAIN_WORDS))
    pair = lambda i: F.struct(F.concat(F.element_at(words, i), F.element_at(words, i + 1)).alias("token"), F.array(F.element_at(words, i), F.element_at(words, i + 1)).alias("parts"))
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), pair)).otherwise(F.array().cast("array<struct<token:string,parts:array<string>>>"))
    return F.concat(F.transform(words, lambda w: F.struct(w.alias("token"), F.array(w).alias("parts"))), pairs)


def rank(values: DataFrame, entries: DataFrame) -> DataFrame:
    """(value, target, score, runner_up) for each distinct ``value``: the targets of ``entries``
    (name, target), best first; one row a value and target that share a token."""
    # tables of distinct tokens are read many times below: each is computed once
    v = values.select("value").where("value is not null").distinct().withColumn("t", F.explode(_tokens(folded(F.col("value"))))).select("value", "t.token", "t.parts").distinct()
    v = cut(v)
    e = entries.select("name", "target").distinct().withColumn("t", F.explode(_tokens(folded(F.col("name"))))).select("name", "target", "t.token", "t.parts").distinct()
    e = cut(e)
    n = entries.select("name").distinct().count()
    singles = e.where("size(parts) = 1").select("name", "target", "token")
    weights = cut(singles.groupBy("token").agg(F.log(F.lit(1.0 + n) / F.count_distinct("name")).alias("w")))
    weighed = singles.join(weights, "token")
    norms = weighed.groupBy("name", "target").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    # an entry's lightest tokens, which all together cannot make the least score, bring up no candidate: a
    # word that many entries share meets only those that hold little else
    lighter = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("name", "target").orderBy("w", "token"))
    heavy = weighed.withColumn("lighter", lighter).join(norms, ["name", "target"]).where((F.col("lighter") >= LEAST_SCORE**2 * F.col("norm") ** 2) | (F.col("w") >= LEAST_STRONGEST * F.log(F.lit(1.0 + n)))).select("name", "target", F.col("token").alias("heavy"))
    repaired = segment_join(v.select(F.col("token").alias("text")), e.select(F.col("token").alias("text")))
    # shortened words ("Wal", "Res"): a typed token of three letters or more that begins a reference token
    heads = v.where("size(parts) = 1 AND length(token) >= 3").select(F.col("token").alias("left")).distinct()
    starts = singles.where("length(token) > 3").select(F.col("token").alias("right")).distinct().withColumn("head", F.explode(F.transform(F.sequence(F.lit(3), F.length("right") - 1), lambda k: F.substring(F.col("right"), F.lit(1), k))))
    short = heads.join(starts, F.col("left") == F.col("head")).select("left", "right", F.lit(0.8).alias("similarity"))
    near = repaired.select("left", "right", (1 - F.when(F.col("edits") < 2, F.col("edits")).otherwise(typing_edits(F.col("left"), F.col("right"))) / F.greatest(F.length("left"), F.length("right"))).alias("similarity")).unionByName(short)
    near = cut(near.where(F.col("similarity") >= LEAST_SIMILARITY).groupBy("left", "right").agg(F.max("similarity").alias("similarity")))
    # a typed token repairs one or, where the blank was lost, two tokens of the entry; two typed tokens
    # as one repair a single token. Two as one against two as one say nothing that they do not say alone.
    hits = v.join(near, F.col("token") == F.col("left")).select("value", "right", "similarity", F.size("parts").alias("n_parts"))
    # one plan with all readers of these tables would need too much of the driver
    hits = cut(hits)
    entry = e.select("name", "target", F.col("token").alias("right"), "parts")
    bringing = entry.withColumn("heavy", F.explode("parts")).join(heavy, ["name", "target", "heavy"]).select("name", "target", "right").distinct()
    candidates = cut(hits.join(bringing, "right").select("value", "name", "target").distinct())
    matched = candidates.join(hits, "value").join(entry, ["name", "target", "right"]).where("NOT (n_parts = 2 AND size(parts) = 2)")
    best = matched.select("value", "name", "target", "similarity", F.explode("parts").alias("token")).groupBy("value", "name", "target", "token").agg(F.max("similarity").alias("similarity")).join(weights, "token")
    dots = cut(best.groupBy("value", "name", "target").agg(F.sum(F.col("w") * F.col("w") * F.col("similarity")).alias("dot"), (F.max(F.col("w") * F.col("similarity")) / F.log(F.lit(1.0 + n))).alias("strongest")))
    # the typed side: each token weighs what its best repair weighs, an unknown one UNKNOWN of the most
    known = near.join(singles.select("token").distinct().join(weights, "token"), F.col("right") == F.col("token")).groupBy("left").agg(F.max_by("w", "similarity").alias("w"))
    v_single, v_pair = v.where("size(parts) = 1").select("value", "token"), v.where("size(parts) = 2")
    # halves of a word with a blank typed into it are no unknown tokens
    healed = v_pair.join(known, F.col("token") == F.col("left")).select("value", F.explode("parts").alias("token"), (F.col("w") / 2).alias("healed")).groupBy("value", "token").agg(F.max("healed").alias("healed"))
    own = v_single.join(known, F.col("token") == F.col("left"), "left").join(healed, ["value", "token"], "left").groupBy("value").agg(F.sqrt(F.sum(F.pow(F.coalesce("w", "healed", F.lit(UNKNOWN) * F.log(F.lit(1.0 + n))), F.lit(2)))).alias("v_norm"))
    scored = dots.join(norms, ["name", "target"]).join(own, "value").where("norm > 0 AND v_norm > 0").withColumn("score", F.least(F.col("dot") / (F.col("norm") * F.col("v_norm")), F.lit(1.0)))
    return cut(scored.groupBy("value", "target").agg(F.max("score").alias("score"), F.max("strongest").alias("strongest")))


def accepted() -> Column:
    return (F.col("score") >= LEAST_SCORE) | (F.col("strongest") >= LEAST_STRONGEST)


def choose(ranked: DataFrame) -> DataFrame:
    """(value, target, score): the best accepted target of each value."""
    return ranked.where(accepted()).groupBy("value").agg(F.max_by("target", F.struct("score", -F.col("target"))).alias("target"), F.max("score").alias("score"))


#: Candidates within this of the best score are settled by other evidence; a position settles within so many kilometres.
TIE, NEAR_KM = 0.1, 30.0


def _km(lat: Column, lon: Column, lat2: Column, lon2: Column) -> Column:
    return F.sqrt(F.pow(lat - lat2, F.lit(2)) + F.pow((lon - lon2) * F.cos(F.radians(lat2)), F.lit(2))) * 111.2


def venue_targets(submitted: DataFrame, venues: DataFrame) -> DataFrame:
    """(venue_id, target, score) of every row of ``submitted``: the canonical venue that its name
    means. Where several venues fit the name about as well, the position decides (also with latitude
    and longitude swapped or a lost sign), else the notes, else the stated canonical id if it is one
    of them; else the name names no single entry and target is null."""
    canonical = venues.groupBy(F.coalesce("canonical_venue_id", "id").alias("target")).agg(F.avg("latitude").alias("v_lat"), F.avg("longitude").alias("v_lon"))
    # what in a note can mean a venue: words that the names of no other one hold
    words = venues.select(F.coalesce("canonical_venue_id", "id").alias("target"), F.explode(F.split(folded(F.col("name")), " ")).alias("w")).where("w <> ''").groupBy("w").agg(F.min("target").alias("target"), F.max("target").alias("last")).where("target = last").groupBy("target").agg(F.collect_set("w").alias("v_words"))
    canonical = canonical.join(words, "target", "left")
    aliases = venues.select(F.col("id").alias("stated_id"), F.coalesce("canonical_venue_id", "id").alias("stated_target"))
    ranked = rank(submitted.select(F.col("name").alias("value")), venues.select("name", F.coalesce("canonical_venue_id", "id").alias("target")))
    top = ranked.where(accepted()).groupBy("value").agg(F.max("score").alias("top"))
    close = ranked.join(top, "value").where((F.col("score") >= F.col("top") - TIE) & accepted()).select("value", "target", "score", "top", "strongest").join(canonical, "target")
    rows = submitted.select("venue_id", F.col("name").alias("value"), "latitude", "longitude", "notes", F.col("canonical_venue_id").alias("stated_id")).join(aliases, "stated_id", "left")
    c = rows.join(close, "value")
    lat, lon = F.col("latitude"), F.col("longitude")
    distance = F.least(_km(lat, lon, F.col("v_lat"), F.col("v_lon")), _km(lon, lat, F.col("v_lat"), F.col("v_lon")), _km(-lat, lon, F.col("v_lat"), F.col("v_lon")))
    noted = F.arrays_overlap(F.split(folded(F.col("notes")), " "), F.col("v_words"))
    c = c.withColumns({"is_near": F.coalesce(distance <= NEAR_KM, F.lit(False)), "km": distance, "is_noted": F.coalesce(noted, F.lit(False)), "is_stated": F.coalesce(F.col("target") == F.col("stated_target"), F.lit(False))})
    order = F.struct("is_near", F.when(F.col("is_near"), -F.col("km")).otherwise(0.0).alias("closer"), "is_noted", "is_stated", F.round("strongest", 2).alias("s"), "score", -F.col("target"))
    best = c.groupBy("venue_id").agg(F.max_by(F.struct("target", "score", "is_near", "is_noted", "is_stated"), order).alias("b"), F.count("*").alias("n"), F.count_if(F.col("score") == F.col("top")).alias("tied"), F.max(F.round("strongest", 2)).alias("s_top"), F.collect_list(F.round("strongest", 2)).alias("s_all"))
    settled = (F.col("n") == 1) | F.col("b.is_near") | F.col("b.is_noted") | F.col("b.is_stated") | (F.col("tied") == 1) | (F.size(F.filter("s_all", lambda x: x >= F.col("s_top") - 0.05)) == 1)
    found = best.select("venue_id", F.when(settled, F.col("b.target")).alias("target"), F.col("b.score").alias("score"))
    return submitted.select("venue_id").distinct().join(found, "venue_id", "left")


def team_targets(values: DataFrame, teams: DataFrame) -> DataFrame:
    """(value, target, score) of distinct typed team names; ``teams`` are the entries that may be meant."""
    named = teams.select("name", F.col("id").alias("target"))
    short = teams.where("length(abbreviation) >= 3").select(F.lower("abbreviation").alias("short"), F.col("id").alias("short_target"))
    distinct = values.select(F.col("value")).where("value is not null").distinct()
    best = distinct.join(choose(rank(values, named)), "value", "left").withColumn("short", folded(F.col("value"))).join(short, "short", "left")
    return best.groupBy("value").agg(F.min(F.coalesce("target", "short_target")).alias("target"), F.max("score").alias("score"))


def p4_found(observations: DataFrame, teams: DataFrame, submitted: DataFrame, venues: DataFrame) -> DataFrame:
    """(table_name, row_key, target_id); target_id -1 where no entry is meant."""
    exact = teams.select(F.col("name").alias("exact")).distinct()
    typed = observations.select(F.col("id").alias("row_key"), F.col("raw_team").alias("value")).distinct()
    open_ = typed.join(exact, F.col("value") == F.col("exact"), "left_anti")
    found = open_.join(team_targets(open_.select("value"), teams.where("competition_id = 1")), "value", "left")
    a = found.select(F.lit("coach_observations").alias("table_name"), "row_key", F.coalesce("target", F.lit(-1)).cast("long").alias("target_id"))
    b = venue_targets(submitted, venues).select(F.lit("venue_geodata").alias("table_name"), F.col("venue_id").alias("row_key"), F.coalesce("target", F.lit(-1)).cast("long").alias("target_id"))
    return a.unionByName(b).distinct()
