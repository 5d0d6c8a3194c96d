"""Vote lines resolved to the players of their match: a cascade of ever looser rules, never a guess.

Tiers, in order: the whole name; the name in plain letters; the same surname and a given name that
begins the other or is begun by it; the same surname and the same first three letters of given names
of three letters or more; the whole name within the season. A tier with one player decides; several
in the first two tiers are ambiguous, as are several of one surname where the closer tiers fail.

Defined results, in ``outcome``: resolved, ambiguous, unresolved_player, unresolved_match,
ambiguous_match. Null names resolve to nothing. Exact copies of a vote line count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def resolve(votes: DataFrame, matches: DataFrame, players: DataFrame) -> DataFrame:
    """(vote_id, match_id, player_id, tier, outcome) of ``votes(vote_id, date, team_id, given, surname,
    season)``, ``matches(match_id, date, home_team_id, away_team_id, season)`` and ``players(match_id,
    team_id, player_id, given, surname, season)``."""
    v = votes.select("vote_id", "date", "team_id", "given", "surname", "season").distinct()
    sides = matches.select("match_id", "date", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).distinct()
    found = v.join(sides, ["date", "team_id"], "left").groupBy("vote_id").agg(F.count_distinct("match_id").alias("n_matches"), F.min("match_id").alias("match_id"))
    placed = v.join(found, "vote_id")
    c = players.select("match_id", "team_id", "player_id", F.col("given").alias("p_given"), F.col("surname").alias("p_surname")).distinct()
    pairs = placed.where("n_matches = 1").join(c, ["match_id", "team_id"])
    same = plain(F.col("surname")) == plain(F.col("p_surname"))
    a, b = plain(F.col("given")), plain(F.col("p_given"))
    begins = F.startswith(a, b) | F.startswith(b, a)
    stem = (F.length(a) >= 3) & (F.substring(a, 1, 3) == F.substring(b, 1, 3))
    tiers = [(F.col("given") == F.col("p_given")) & (F.col("surname") == F.col("p_surname")), (a == b) & same, same & begins, same & stem, same]
    hits = pairs.groupBy("vote_id").agg(*[x for k, t in enumerate(tiers, 1) for x in (F.count_if(t).alias(f"n{k}"), F.max(F.when(t, F.col("player_id"))).alias(f"p{k}"))])
    season = players.select("season", "player_id", F.col("given").alias("p_given"), F.col("surname").alias("p_surname")).distinct()
    by_season = placed.join(season, "season").where((F.col("given") == F.col("p_given")) & (F.col("surname") == F.col("p_surname"))).groupBy("vote_id").agg(F.count("*").alias("n6"), F.max("player_id").alias("p6"))
    j = placed.join(hits, "vote_id", "left").join(by_season, "vote_id", "left").na.fill(0, [f"n{k}" for k in range(1, 7)])
    n = lambda k: F.col(f"n{k}")
    tier = (
        F.when(n(1) == 1, 1).when(n(1) > 1, 0).when(n(2) == 1, 2).when(n(2) > 1, 0).when(n(3) == 1, 3).when(n(4) == 1, 4)
        .when((n(3) > 1) | (n(4) > 1) | (n(5) > 1), 0).when(n(6) == 1, 6).when(n(6) > 1, 0)
    )
    j = j.withColumn("tier", F.when(F.col("n_matches") == 1, tier))
    player = F.coalesce(*[F.when(F.col("tier") == k, F.col(f"p{k}")) for k in (1, 2, 3, 4, 6)])
    outcome = F.when(F.col("n_matches") == 0, "unresolved_match").when(F.col("n_matches") > 1, "ambiguous_match").when(F.col("tier").isNull(), "unresolved_player").when(F.col("tier") == 0, "ambiguous").otherwise("resolved")
    return j.select("vote_id", F.when(F.col("n_matches") == 1, F.col("match_id")).alias("match_id"), player.alias("player_id"), F.when(F.col("tier") > 0, F.col("tier")).alias("tier"), outcome.alias("outcome"))
