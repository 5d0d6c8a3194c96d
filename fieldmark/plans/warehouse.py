"""Queries of the sports warehouse: ladder, library queries, integrity views, player value, coverage.

Every query works on all competitions and seasons at once and carries them as keys, so that one job
answers what would otherwise be a loop over seasons. Home and away sides are unpivoted with one scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.sources import read_table

# Competition codes by id.
COMPETITIONS = {1: "AFLM", 2: "AFLW", 3: "VFL", 4: "VFLW"}
# First season for which player value can be computed, by competition.
VALUE_SINCE = {1: 1998, 2: 2017}
VALUE_INPUTS = ("goals", "behinds", "hitouts", "goal_assists", "inside_fifties", "marks_inside_fifty", "free_kicks_for", "free_kicks_against", "rebounds", "one_percenters", "marks", "clearances", "tackles")


class Warehouse:
    """The tables of one snapshot directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.directory, name)

    def competitions(self) -> DataFrame:
        return self.spark.createDataFrame(list(COMPETITIONS.items()), "competition_id int, code string")

    def matches(self) -> DataFrame:
        """Matches with competition_id, code and year of their season."""
        m = self.table("matches").withColumns({"competition_id": F.expr("CAST(season_id div 10000 AS INT)"), "year": F.expr("CAST(season_id % 10000 AS INT)")})
        code = F.create_map(*[F.lit(x) for kv in COMPETITIONS.items() for x in kv])
        return m.withColumn("code", code[F.col("competition_id")])

    def stats(self, *columns: str) -> DataFrame:
        """Statistic lines as last delivered: of the rows of one id the one with the latest load."""
        s = self.table("player_match_stats").select("id", "load_no", *columns)
        latest = Window.partitionBy("id").orderBy(F.col("load_no").desc_nulls_last())
        return s.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n", "load_no")

    def sides(self) -> DataFrame:
        """Two rows a match, one for each team: team_id, is_home, points_for, points_against."""
        m = self.matches()
        side = lambda mine, other, home: F.struct(F.col(f"{mine}_team_id").alias("team_id"), F.lit(home).alias("is_home"), F.col(f"{mine}_points").alias("points_for"), F.col(f"{other}_points").alias("points_against"))
        keep = [F.col(c) for c in ("id", "season_id", "competition_id", "code", "year", "round_type", "round_abbreviation", "status", "date")]
        return m.select(*keep, F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("s")).select(*keep, "s.*")


def ladder(w: Warehouse) -> DataFrame:
    """Home-and-away ladder of every season: four points a win, two a draw, percentage to one decimal."""
    teams = w.table("teams").select(F.col("id").alias("team_id"), F.col("name").alias("team"))
    played = w.sides().where("round_type = 'Regular' AND NOT (round_abbreviation <=> 'WC') AND status = 'Complete'")
    won, lost, drew = (F.col("points_for") > F.col("points_against")), (F.col("points_for") < F.col("points_against")), (F.col("points_for") == F.col("points_against"))
    by = played.groupBy("code", "year", "team_id").agg(
        F.count("*").alias("played"),
        F.count_if(won).alias("wins"),
        F.count_if(lost).alias("losses"),
        F.count_if(drew).alias("draws"),
        F.sum("points_for").alias("points_for"),
        F.sum("points_against").alias("points_against"),
    )
    percentage = F.round(100.0 * F.col("points_for") / F.nullif("points_against", F.lit(0)), 1)
    return by.join(teams, "team_id").select("code", "year", "team", "played", "wins", "losses", "draws", "points_for", "points_against", percentage.alias("percentage"), (F.col("wins") * 4 + F.col("draws") * 2).alias("premiership_points"))


def _named(w: Warehouse, m: DataFrame) -> DataFrame:
    t = w.table("teams")
    home = t.select(F.col("id").alias("home_team_id"), F.col("name").alias("home_team"))
    away = t.select(F.col("id").alias("away_team_id"), F.col("name").alias("away_team"))
    return m.join(home, "home_team_id").join(away, "away_team_id")


def match_names(w: Warehouse) -> DataFrame:
    """Matches with the names of competition, both teams and venue."""
    venues = w.table("venues").select(F.col("id").alias("venue_id"), F.col("name").alias("venue"))
    return _named(w, w.matches()).join(venues, "venue_id").select(F.col("id").alias("match_id"), "code", "year", "date", "round", "home_team", "away_team", "home_points", "away_points", "margin", "venue")


def grand_finals(w: Warehouse) -> DataFrame:
    """The last Finals match of each season by id, with its winner's margin."""
    finals = w.matches().where("round_type = 'Finals' AND status = 'Complete'")
    last = finals.groupBy("code", "year").agg(F.max("id").alias("id"))
    return _named(w, finals.join(last.select("id"), "id")).select("code", "year", F.col("id").alias("match_id"), "home_team", "away_team", F.abs("margin").alias("winning_margin"))


def career_arc(w: Warehouse) -> DataFrame:
    """Games, disposals and goals of every player and season."""
    m = w.matches().select(F.col("id").alias("match_id"), "code", "year")
    return w.stats("match_id", "player_id", "disposals", "goals").join(m, "match_id").groupBy("code", "year", "player_id").agg(F.count("*").alias("games"), F.sum("disposals").alias("total_disposals"), F.sum("goals").alias("total_goals"))


def career_values(w: Warehouse) -> DataFrame:
    """Games, disposals, goals and value of every player and season, with names. The value joins by player
    and season alone, so a player with values for two teams has a row for each of them."""
    m = w.matches().select(F.col("id").alias("match_id"), "season_id", "code", "year")
    names = w.table("players").select(F.col("id").alias("player_id"), "first_name", "surname").dropDuplicates(["player_id"])
    value = season_value(w, False).select("season_id", "player_id", "off_value", "mid_value", "def_value", "total_value")
    sums = w.stats("match_id", "player_id", "disposals", "goals").join(m, "match_id").groupBy("season_id", "code", "year", "player_id").agg(F.count("*").alias("games"), F.sum("disposals").alias("total_disposals"), F.sum("goals").alias("total_goals"))
    # two teams with the very same values are one group
    return sums.join(value.distinct(), ["season_id", "player_id"], "left").join(names, "player_id", "left").select("code", "year", "player_id", "first_name", "surname", "games", "total_disposals", "total_goals", "total_value")


def source_comparisons(w: Warehouse) -> DataFrame:
    """Coach names of two providers for the same day and team where they differ as typed: the match where
    it is stated, else the typed day and team."""
    o = w.table("coach_observations").select("provider", F.coalesce(F.concat_ws("/", F.lit("m"), F.col("match_id"), F.col("team_id")), F.lit("")).alias("stated"), "match_id", "match_date", "raw_team", "display_name", "coach_id").distinct()
    key = F.when(F.col("match_id").isNotNull(), F.col("stated")).otherwise(F.concat_ws("/", "match_date", "raw_team"))
    o = o.where("match_id is not null OR match_date is not null AND raw_team is not null").select("provider", key.alias("slot"), "display_name", "coach_id")
    a = o.where("provider = 'afl-tables'").select("slot", F.col("display_name").alias("first_coach"), F.col("coach_id").alias("first_id")).distinct()
    b = o.where("provider = 'footywire'").select("slot", F.col("display_name").alias("second_coach"), F.col("coach_id").alias("second_id")).distinct()
    return a.join(b, "slot").where("first_id <> second_id").select("slot", "first_coach", "second_coach")


def lineup_changes(w: Warehouse) -> DataFrame:
    """Ins and outs of every team between its consecutive listed matches, emergencies excluded."""
    m = w.matches().select(F.col("id").alias("match_id"), "season_id")
    listed = w.table("match_lineups").where("is_emergency = 0").select("match_id", "team_id", "player_id").distinct().join(m, "match_id")
    played = listed.select("season_id", "team_id", "match_id").distinct()
    order = Window.partitionBy("season_id", "team_id").orderBy("match_id")
    steps = played.select("team_id", "match_id", F.lag("match_id").over(order).alias("previous_id")).where("previous_id is not null")
    now = steps.join(listed.select("team_id", "match_id", "player_id"), ["team_id", "match_id"])
    before = steps.join(listed.select("team_id", F.col("match_id").alias("previous_id"), "player_id"), ["team_id", "previous_id"])
    keys = ["team_id", "match_id", "previous_id", "player_id"]
    ins = now.select(*keys).join(before.select(*keys), keys, "left_anti").withColumn("change", F.lit("IN"))
    outs = before.select(*keys).join(now.select(*keys), keys, "left_anti").withColumn("change", F.lit("OUT"))
    return ins.unionByName(outs)


def wet_games(w: Warehouse) -> DataFrame:
    """Complete matches with at least 2 mm of observed rain at open grounds, through the canonical venue."""
    v = w.table("venues")
    canonical = v.select(F.col("id").alias("c_id"), "roof")
    ground = v.select(F.col("id").alias("venue_id"), F.coalesce("canonical_venue_id", "id").alias("c_id")).join(canonical, "c_id").where("roof = 'none'").select("venue_id")
    rain = w.table("match_weather").where("kind = 'observed' AND precip_mm >= 2.0").select(F.col("match_id").alias("id"), "precip_mm", "precip_24h_prior_mm").distinct()
    return _named(w, w.matches().where("status = 'Complete'")).join(rain, "id").join(ground, "venue_id").select(F.col("id").alias("match_id"), "year", "home_team", "away_team", (F.col("home_points") + F.col("away_points")).alias("total_points"), "precip_mm", "precip_24h_prior_mm")


def tipping(w: Warehouse) -> DataFrame:
    """Accuracy of tipping the side that led after the first quarter, level counting as home. The
    prediction is a stand-in: (home lead + 0.5 goals) as margin. Draws count for the error only."""
    m = w.matches().where("status = 'Complete' AND home_points is not null AND away_points is not null")
    lead = 6 * (F.col("home_q1_goals") - F.col("away_q1_goals")) + F.col("home_q1_behinds") - F.col("away_q1_behinds")
    m = m.withColumn("predicted", lead)
    right = ((F.col("predicted") >= 0) & (F.col("home_points") > F.col("away_points"))) | ((F.col("predicted") < 0) & (F.col("away_points") > F.col("home_points")))
    decisive = F.col("predicted").isNotNull() & (F.col("home_points") != F.col("away_points"))
    s = m.groupBy("code", "year").agg(
        F.count("*").alias("completed"),
        F.count("predicted").alias("predictions"),
        F.count_if(right).alias("correct"),
        F.count_if(decisive).alias("decisive"),
        F.count_if(F.col("predicted").isNotNull() & (F.col("home_points") == F.col("away_points"))).alias("draws"),
        F.round(F.avg(F.abs(F.col("predicted") - (F.col("home_points") - F.col("away_points")))), 3).alias("margin_mae"),
    )
    return s.withColumn("accuracy_pct", F.round(100.0 * F.col("correct") / F.nullif("decisive", F.lit(0)), 3))


def integrity(w: Warehouse, which: str) -> DataFrame:
    """One row for each violation of an invariant; rows with a null operand break none."""
    m = w.table("matches")
    if which == "margin":
        return m.where("margin <> home_points - away_points").select(F.col("id").alias("match_id"), "home_points", "away_points", "margin")
    if which == "match_points":
        return m.where("home_points <> home_goals * 6 + home_behinds OR away_points <> away_goals * 6 + away_behinds").select(F.col("id").alias("match_id"), "home_points", "away_points")
    if which == "quarter_scores":
        off = [F.col(f"{s}_{k}") != reduce(lambda a, b: a + b, [F.col(f"{s}_q{q}_{k}") for q in range(1, 5)]) for s in ("home", "away") for k in ("goals", "behinds")]
        return m.where(F.col("home_q1_goals").isNotNull() & reduce(lambda a, b: a | b, off)).select(F.col("id").alias("match_id"))
    if which == "disposals":
        return w.stats("match_id", "player_id", "kicks", "handballs", "disposals").where("disposals <> kicks + handballs").withColumnRenamed("id", "row_id")
    if which == "clearances":
        return w.stats("match_id", "player_id", "centre_clearances", "stoppage_clearances", "clearances").where("clearances <> centre_clearances + stoppage_clearances").withColumnRenamed("id", "row_id")
    if which == "votes":
        totals = w.stats("match_id", "brownlow_votes").groupBy("match_id").agg(F.sum("brownlow_votes").alias("total")).where("total > 0 AND total <> 6")
        return totals.join(m.where("round_type = 'Regular'").select(F.col("id").alias("match_id")), "match_id")
    raise ValueError(f"no invariant {which!r}")


def integrity_counts(w: Warehouse) -> DataFrame:
    """For each invariant how many rows have all its operands, and how many of them break it."""
    quarters = [(F.col(f"{s}_{k}"), reduce(lambda a, b: a + b, [F.col(f"{s}_q{q}_{k}") for q in range(1, 5)])) for s in ("home", "away") for k in ("goals", "behinds")]
    matches = {
        "margin": [(F.col("margin"), F.col("home_points") - F.col("away_points"))],
        "match_points": [(F.col(f"{s}_points"), F.col(f"{s}_goals") * 6 + F.col(f"{s}_behinds")) for s in ("home", "away")],
        "quarter_scores": quarters,
    }
    lines = {"disposals": [(F.col("disposals"), F.col("kicks") + F.col("handballs"))], "clearances": [(F.col("clearances"), F.col("centre_clearances") + F.col("stoppage_clearances"))]}
    parts = []
    for table, checks in ((w.table("matches"), matches), (w.stats("kicks", "handballs", "disposals", "clearances", "centre_clearances", "stoppage_clearances"), lines)):
        found = table.agg(*[F.struct(F.count_if(reduce(lambda a, b: a & b, [(x - y).isNotNull() for x, y in pairs])).alias("checked"), F.count_if(reduce(lambda a, b: a | b, [F.coalesce(x != y, F.lit(False)) for x, y in pairs])).alias("broken")).alias(name) for name, pairs in checks.items()])
        parts.append(found.select(F.explode(F.array(*[F.struct(F.lit(n).alias("invariant"), f"{n}.checked", f"{n}.broken") for n in checks])).alias("x")).select("x.*"))
    return parts[0].unionByName(parts[1])


def value_gaps(w: Warehouse) -> DataFrame:
    """For each season what keeps its player values unknown: matches without a score, sides without lines,
    lines without an input; and whether nothing does."""
    m = w.matches().where("status = 'Complete'")
    played = m.select(F.col("id").alias("match_id"), "season_id", (F.col("home_points").isNull() | F.col("away_points").isNull()).alias("unscored"), F.explode(F.array("home_team_id", "away_team_id")).alias("team_id"))
    broken = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in VALUE_INPUTS])
    lines = w.stats("match_id", "team_id", *VALUE_INPUTS).groupBy("match_id", "team_id").agg(F.count_if(broken).alias("broken"))
    g = played.join(lines, ["match_id", "team_id"], "left").groupBy("season_id").agg(F.count_if("unscored").alias("unscored_sides"), F.count_if(F.col("broken").isNull()).alias("sides_without_lines"), F.sum(F.coalesce("broken", F.lit(0))).alias("lines_without_input"))
    return g.withColumn("complete", F.expr("unscored_sides + sides_without_lines + lines_without_input = 0"))


def player_value(matches: DataFrame, stats: DataFrame, require_complete: bool = True) -> DataFrame:
    """(season_id, player_id, team_id, off_value, mid_value, def_value, total_value) of all seasons.

    ``matches``: id, season_id, home_team_id, away_team_id, points of both sides, status. ``stats``:
    one line a match and player with the inputs, time_on_ground_pct and disposals. A season in which a
    played match lacks a score, a side's lines or any input keeps its rows, with null values, unless
    ``require_complete`` is off: unknown inputs then count nothing, as they do in the sums anyway.
    """
    played = matches.where("status = 'Complete'").select(F.col("id").alias("match_id"), "season_id", "home_team_id", "away_team_id", "home_points", "away_points")
    broken_line = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in VALUE_INPUTS])
    per_team = stats.groupBy("match_id", "team_id").agg(F.sum(F.coalesce("inside_fifties", F.lit(0))).alias("i50"), F.bool_or(broken_line).alias("broken"))
    side = lambda me, it: F.struct(F.col(f"{me}_team_id").alias("team_id"), F.col(f"{it}_team_id").alias("other_id"), F.col(f"{me}_points").alias("pf"), F.col(f"{it}_points").alias("pa"))
    sides = played.select("match_id", "season_id", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")).select("match_id", "season_id", "s.*")
    other = per_team.select("match_id", F.col("team_id").alias("other_id"), F.col("i50").alias("i50_against"))
    joined = sides.join(per_team, ["match_id", "team_id"], "left").join(other, ["match_id", "other_id"], "left")
    gap = F.col("pf").isNull() | F.col("pa").isNull() | F.col("i50").isNull() | F.coalesce("broken", F.lit(False))
    complete = joined.groupBy("season_id").agg((F.count_if(gap) == 0).alias("complete"))
    scored = joined.where("pf is not null AND pa is not null AND i50 is not null AND i50_against is not null")
    team = scored.groupBy("season_id", "team_id").agg(*[F.sum(c).cast("double").alias(c) for c in ("pf", "pa", "i50", "i50_against")])
    league = team.groupBy("season_id").agg((F.sum("pf") / F.nullif(F.sum("i50"), F.lit(0.0))).alias("average"), F.count("*").alias("teams"))
    per_entry = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0.0))
    rated = team.join(league, "season_id").select(
        "season_id", "team_id", "teams",
        (per_entry("pf", "i50") / F.nullif("average", F.lit(0.0))).alias("off"),
        per_entry("i50", "i50_against").alias("mid"),
        (per_entry("pa", "i50_against") / F.nullif("average", F.lit(0.0))).alias("conceded"),
    ).withColumn("def", F.when(F.col("conceded") != 0, 100 * (2 - F.col("conceded"))))
    sums = rated.groupBy("season_id").agg(*[F.nullif(F.sum(c), F.lit(0.0)).alias(f"sum_{c}") for c in ("off", "mid", "def")])
    pools = rated.join(sums, "season_id").select("season_id", "team_id", *[(F.col(c) / F.col(f"sum_{c}") * F.col("teams") * 100).alias(f"pool_{c}") for c in ("off", "mid", "def")])
    c = {x: F.coalesce(F.col(x), F.lit(0)) for x in VALUE_INPUTS}
    frees = c["free_kicks_for"] - c["free_kicks_against"]
    lines = stats.where("time_on_ground_pct > 0 OR disposals > 0").join(played.select("match_id", "season_id"), "match_id").select(
        "season_id", "team_id", "player_id",
        (6 * c["goals"] + c["behinds"] + 0.25 * c["hitouts"] + 3 * c["goal_assists"] + c["inside_fifties"] + c["marks_inside_fifty"] + frees).alias("off"),
        (15 * c["inside_fifties"] + 20 * c["clearances"] + 3 * c["tackles"] + 1.5 * c["hitouts"] + frees).alias("mid"),
        (20 * c["rebounds"] + 12 * c["one_percenters"] + c["marks"] - 4 * c["marks_inside_fifty"] + 2 * frees - 2.0 / 3.0 * c["hitouts"]).alias("def"),
    )
    players = lines.groupBy("season_id", "team_id", "player_id").agg(*[F.sum(x).alias(x) for x in ("off", "mid", "def")])
    totals = players.groupBy("season_id", "team_id").agg(*[F.nullif(F.sum(x), F.lit(0.0)).alias(f"team_{x}") for x in ("off", "mid", "def")])
    shares = players.join(totals, ["season_id", "team_id"]).join(pools, ["season_id", "team_id"]).join(complete, "season_id")
    value = {x: F.col(x) / F.col(f"team_{x}") * F.col(f"pool_{x}") for x in ("off", "mid", "def")}
    known = F.col("complete") | F.lit(not require_complete)
    value["total"] = value["off"] + value["mid"] + value["def"]
    # no negative zero
    rounded = [F.when(known, F.when(F.round(v, 2) == 0, 0.0).otherwise(F.round(v, 2))).alias(f"{x}_value") for x, v in value.items()]
    return shares.select("season_id", "player_id", "team_id", *rounded)


def season_value(w: Warehouse, require_complete: bool = True) -> DataFrame:
    since = F.create_map(*[F.lit(x) for kv in VALUE_SINCE.items() for x in kv])
    m = w.matches().where(F.col("year") >= since[F.col("competition_id")])
    return player_value(m, w.stats("match_id", "team_id", "player_id", "time_on_ground_pct", "disposals", *VALUE_INPUTS), require_complete)


def team_values(w: Warehouse) -> DataFrame:
    """Player values with the names of player and team."""
    p = w.table("players").select(F.col("id").alias("player_id"), "first_name", "surname")
    t = w.table("teams").select(F.col("id").alias("team_id"), F.col("name").alias("team"))
    return season_value(w, False).join(p, "player_id").join(t, "team_id").select("season_id", "player_id", "first_name", "surname", "team", "total_value")


def match_coaches(w: Warehouse) -> DataFrame:
    """Matches of the first competition with the coaches that one provider names, where it does."""
    o = w.table("coach_observations").where("provider = 'afl-tables' AND match_id is not null AND team_id is not null")
    named = o.groupBy(F.col("match_id").alias("id"), "team_id").agg(F.min("display_name").alias("coach"))
    home = named.select("id", F.col("team_id").alias("home_team_id"), F.col("coach").alias("home_coach"))
    away = named.select("id", F.col("team_id").alias("away_team_id"), F.col("coach").alias("away_coach"))
    m = w.matches().where("competition_id = 1").join(home, ["id", "home_team_id"], "left").join(away, ["id", "away_team_id"], "left")
    return _named(w, m).select(F.col("id").alias("match_id"), "home_team", "away_team", "home_coach", "away_coach")


def swapped_sides(w: Warehouse) -> DataFrame:
    """Matches with home and away exchanged in every paired field and the margin's sign turned."""
    m = w.table("matches")
    other = {c: c.replace("home_", "away_") if c.startswith("home_") else c.replace("away_", "home_") for c in m.columns if c.startswith(("home_", "away_"))}
    return m.select("id", (-F.col("margin")).alias("margin"), *[F.col(o).alias(c) for c, o in other.items()])


def coverage(w: Warehouse) -> DataFrame:
    """Share of known values of every statistic by competition and season, in one aggregation."""
    columns = [c for c in w.table("player_match_stats").columns if c not in ("id", "match_id", "player_id", "team_id", "load_no")]
    m = w.matches().select(F.col("id").alias("match_id"), "code", "year")
    known = w.stats("match_id", *columns).join(m, "match_id").groupBy("code", "year").agg(F.count("*").alias("n_rows"), *[F.count(c).alias(c) for c in columns])
    long = known.select("code", "year", "n_rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("known")) for c in columns])).alias("x"))
    return long.select("code", "year", "x.column_name", "n_rows", "x.known", F.round(F.col("x.known") / F.nullif("n_rows", F.lit(0)), 6).alias("ratio"))


def match_inventory(w: Warehouse) -> DataFrame:
    """Matches of each season by state, with statistics, line-ups and weather present: unsettled is
    every status but Complete and Cancelled, null included."""
    lines = w.table("player_match_stats").select("match_id").distinct().withColumn("s", F.lit(1))
    listed = w.table("match_lineups").select("match_id").distinct().withColumn("l", F.lit(1))
    seen = w.table("match_weather").where("kind = 'observed'").select("match_id").distinct().withColumn("w", F.lit(1))
    m = w.matches().withColumnRenamed("id", "match_id").join(lines, "match_id", "left").join(listed, "match_id", "left").join(seen, "match_id", "left")
    return m.groupBy("code", "year").agg(F.count("*").alias("n_matches"), F.count_if(F.col("status") == "Complete").alias("played"), F.count_if(F.col("status") == "Cancelled").alias("cancelled"), F.count_if(~F.coalesce(F.col("status").isin("Complete", "Cancelled"), F.lit(False))).alias("unsettled"), F.count("s").alias("with_statistics"), F.count("l").alias("with_lineups"), F.count("w").alias("with_weather"))


def audit(w: Warehouse) -> DataFrame:
    """(issue, record_id) findings: played matches without statistics, line-ups naming players unknown
    to ``players``, statistic lines of unknown matches, players whose value is unknown."""
    played = w.matches().where("status = 'Complete'").select(F.col("id").alias("match_id"))
    stats, lineups = w.table("player_match_stats").select("match_id").distinct(), w.table("match_lineups").select(F.col("player_id").alias("id")).distinct()
    kinds = [
        ("played-without-statistics", played.join(stats, "match_id", "left_anti").select(F.col("match_id").alias("record"))),
        ("listed-player-unknown", lineups.join(w.table("players").select("id"), "id", "left_anti").select(F.col("id").alias("record"))),
        ("statistics-of-unknown-match", stats.join(w.table("matches").select(F.col("id").alias("match_id")), "match_id", "left_anti").select(F.col("match_id").alias("record"))),
        ("value-unknown", season_value(w).where("total_value is null").select(F.col("player_id").alias("record")).distinct()),
    ]
    return reduce(DataFrame.unionByName, [df.select(F.lit(issue).alias("issue"), F.col("record").cast("string").alias("record_id")) for issue, df in kinds])


def audit_page(w: Warehouse, most: int = 100) -> DataFrame:
    """The first ``most`` findings of :func:`audit`, and whether there are more: one finding more than
    asked for is looked at, and no count of them all."""
    probe = audit(w).orderBy("issue", "record_id").limit(most + 1)
    ranked = probe.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("issue", "record_id")))  # at most most + 1 rows
    return ranked.withColumn("truncated", F.max("_n").over(Window.partitionBy(F.lit(1))) > most).where(F.col("_n") <= most).select("issue", "record_id", "truncated")


def weather_sanity(w: Warehouse) -> DataFrame:
    """Counts of missing and impossible readings by source."""
    d = w.table("match_weather")
    bad: dict[str, Column] = {"bad_temp": ~F.col("temp_c").between(-20, 55), "bad_humidity": ~F.col("humidity_pct").between(0, 100), "bad_rain": F.col("precip_mm") < 0, "gust_below_wind": F.col("wind_gust_kmh") < F.col("wind_speed_kmh")}
    return d.groupBy("source").agg(F.count("*").alias("n_rows"), F.count_if(F.col("temp_c").isNull()).alias("no_temp"), *[F.count_if(c).alias(k) for k, c in bad.items()])


def birth_coverage(w: Warehouse) -> DataFrame:
    """Players with a date of birth, and ages at their last match outside 15 to 45, by competition."""
    m = w.matches().select(F.col("id").alias("match_id"), "code", "year")
    last = w.stats("match_id", "player_id").join(m, "match_id").groupBy("code", "player_id").agg(F.max("year").alias("last_year"))
    p = w.table("players").select(F.col("id").alias("player_id"), F.substring("date_of_birth", 1, 4).cast("int").alias("born"))
    age = F.col("last_year") - F.col("born")
    return last.join(p, "player_id").groupBy("code").agg(F.count("*").alias("n_players"), F.count("born").alias("with_birth"), F.count_if(~age.between(15, 45)).alias("odd_ages"), F.min(age).alias("youngest"), F.max(age).alias("oldest"))
