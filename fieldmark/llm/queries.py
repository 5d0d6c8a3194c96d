"""Queries of the llm subpackage and their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import canonical, leaks, lookalike, matching, mixing, persons, survivors
from fieldmark.plans.lineage import cut
from fieldmark.sources import read_table


def _people(spark: SparkSession, d: str) -> DataFrame:
    return cut(survivors.persons(read_table(spark, d, "players")))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    tables = (read_table(spark, d, t) for t in ("coach_observations", "coach_external_ids", "brownlow_player_records", "teams", "players", "player_match_stats"))
    return cut(persons.members(*tables, _people(spark, d)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return persons.p2_found(_linked(spark, d))


def p2_members(spark: SparkSession, d: str) -> DataFrame:
    """Every linked record with its person, and how many records that person has."""
    linked = _linked(spark, d)
    return linked.join(linked.groupBy("person").agg(F.count("*").alias("records")), "person").select("key", "person", "records")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.p5_found(survivors.confirm(read_table(spark, d, "players"), _people(spark, d)))


def p5_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One record a person, of the groups as confirmed."""
    players = read_table(spark, d, "players")
    return survivors.survivors(players, cut(survivors.confirm(players, _people(spark, d))))


def p5_lines(spark: SparkSession, d: str) -> DataFrame:
    """Statistic lines and line-up places of each person with several ids, once re-pointed to the person."""
    people = _people(spark, d)
    several = people.groupBy("person_id").agg(F.count("*").alias("ids")).where("ids > 1")
    lines = survivors.repointed(read_table(spark, d, "player_match_stats").select("match_id", "player_id").distinct(), people).groupBy("player_id").agg(F.count("*").alias("lines"), F.count_distinct("match_id").alias("matches"))
    places = survivors.repointed(read_table(spark, d, "match_lineups").select("match_id", "player_id").distinct(), people).groupBy("player_id").agg(F.count_distinct("match_id").alias("listed"))
    return several.join(lines, several.person_id == lines.player_id, "left").drop("player_id").join(places, F.col("person_id") == places.player_id, "left").drop("player_id").na.fill(0)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return mixing.report(*mixing.schedule(read_table(spark, d, "documents"), read_table(spark, d, "source_targets")))


def p9_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The mixture: every use of every document, by slot."""
    return mixing.schedule(read_table(spark, d, "documents"), read_table(spark, d, "source_targets"))[0]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.p4_found(*(read_table(spark, d, t) for t in ("coach_observations", "teams", "venue_geodata", "venues")))


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed team names that name no team, and how many observations have each."""
    o = read_table(spark, d, "coach_observations").select("id", F.col("raw_team").alias("value")).distinct()
    found = canonical.team_targets(o.select("value"), read_table(spark, d, "teams").where("competition_id = 1"))
    return o.join(found.where("target is null"), "value").groupBy("value").agg(F.count("*").alias("n"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return matching.p6_found(_matched(spark, d))


def p6_confidence(spark: SparkSession, d: str) -> DataFrame:
    """How many observations were matched at each tenth of confidence."""
    return _matched(spark, d).groupBy(F.floor(F.col("confidence") * 10).cast("int").alias("tenth")).agg(F.count("*").alias("n"))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return matching.match(*(read_table(spark, d, t) for t in ("coach_observations", "teams", "matches")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.p8_found(leaks.find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents leak each item, and the largest share of it."""
    found = leaks.find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.round(F.max("share"), 4).alias("largest_share"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.p10_found(read_table(spark, d, "documents"))


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document of a class with several spellings, with its class."""
    return lookalike.memberships(read_table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_members, p4_found, p4_unmatched, p5_found, p5_survivors, p5_lines, p6_found, p6_confidence, p8_found, p8_items, p9_mixture, p9_schedule, p10_found, p10_classes)}
SQL: dict[str, str] = {}
