"""Queries that run the engine's operators over the snapshot's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.functions import labels
from fieldmark.operators import hourly, upsert, votes
from fieldmark.operators.instants import date_of
from fieldmark.sources import read_table
from fieldmark.streaming.batches import windowed

MEASURES = ("kicks", "handballs", "disposals", "marks", "tackles")
STAT_RULES = [upsert.Rule("id", "key"), upsert.Rule("match_id", "replace"), upsert.Rule("player_id", "replace"), *[upsert.Rule(c) for c in MEASURES]]


def _deliveries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Statistic lines delivered by odd and by even loads, the latest of each id."""
    s = read_table(spark, d, "player_match_stats").select("id", "match_id", "player_id", *MEASURES, "load_no")
    pick = lambda rows: upsert.latest(rows, ["id"], [F.col("load_no").desc_nulls_last()]).drop("load_no")
    return pick(s.where("load_no % 2 = 1")), pick(s.where("load_no % 2 = 0"))


def merge_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Even deliveries merged into odd ones: known values stay where the new ones are null."""
    old, new = _deliveries(spark, d)
    return upsert.merge(old, new, STAT_RULES)


def merge_affected(spark: SparkSession, d: str) -> DataFrame:
    """Matches whose lines the merge changed, those too that a line has left."""
    old, new = _deliveries(spark, d)
    return upsert.affected(upsert.merge(old, new, STAT_RULES, ("match_id",)), "match_id")


def merge_insert_missing(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' nations added to the customers' where missing."""
    c = read_table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    s = read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).distinct()
    return upsert.insert_missing(c, s, ["k"])


def replace_groups(spark: SparkSession, d: str) -> DataFrame:
    """Line-ups with those of every match replaced by the starters alone."""
    all_ = read_table(spark, d, "match_lineups").select("id", "match_id", "player_id", "is_emergency", "is_substitute")
    new = all_.where("is_emergency = 0 AND is_substitute = 0")
    return upsert.replace_groups(all_, new, ["match_id"])


def merged_identity(spark: SparkSession, d: str) -> DataFrame:
    """Line-up places of a player in a match as one row; differing values are conflicts."""
    rows = read_table(spark, d, "match_lineups")
    m = upsert.merged_identity(rows, ["match_id", "player_id"], ["team_id", "guernsey_number"])
    return m.select("match_id", "player_id", "team_id", "guernsey_number", F.size("conflicts").alias("n_conflicts"))


def constraints(spark: SparkSession, d: str) -> DataFrame:
    """Broken constraints of the matches."""
    m, t = read_table(spark, d, "matches"), read_table(spark, d, "teams")
    return upsert.broken_constraints(m, [["id"], ["external_afl_id"]], ["venue_id", "status"], {"round_type": ["Regular", "Finals"], "completed_quarter": [0, 1, 2, 3, 4]}, {"home_team_id": t.select("id"), "venue_id": read_table(spark, d, "venues").select("id")})


def numbered_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers as new rows after the greatest order key, in order of their own key."""
    o, c = read_table(spark, d, "orders").select("o_orderkey", "o_custkey"), read_table(spark, d, "customer")
    new = c.select("c_custkey")
    return upsert.with_keys(o, new, "o_orderkey", ["c_custkey"])


def hourly_windows(spark: SparkSession, d: str) -> DataFrame:
    """Strict windows over hourly figures of the events, one series an event type, for every hour: the
    four metrics that SQL gives without a half-up mean."""
    return hourly_windows_all(spark, d).select("id", "precip", "prior_precip", F.round("gust", 2).alias("gust"))


def hourly_windows_all(spark: SparkSession, d: str) -> DataFrame:
    """All six metrics of the strict windows over hourly figures of the events, for every hour of every
    series. The SQL of hourly_windows covers the metrics without means; this one has a fixture."""
    e = read_table(spark, d, "events").select("event_type", "value", (F.unix_timestamp("ts") - F.unix_timestamp("ts") % 3600).alias("hour"))
    mean = hourly.half_up(F.avg("value"), 1)
    hours = e.groupBy(F.col("event_type").alias("series"), "hour").agg(mean.alias("temp"), F.min("value").alias("humidity"), F.count("*").cast("double").alias("precip"), F.max("value").alias("wind"), F.max("value").alias("gust"))
    targets = hours.select(F.concat("series", F.lit("@"), F.col("hour").cast("string")).alias("id"), "series", F.col("hour").alias("start"))
    return hourly.windows(targets, hours)


def vote_lines(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes and tiers of the typed vote records against the players of their match, which is found by
    the record's day and team. Records whose match is unknown are counted with the rest."""
    m = read_table(spark, d, "matches")
    day = F.date_format(date_of(F.coalesce("date", "kickoff_at")), "yyyy-MM-dd")
    matches = m.select(F.col("id").alias("match_id"), day.alias("date"), "home_team_id", "away_team_id", F.col("season_id").alias("season"))
    of = matches.select(F.col("match_id").alias("_match"), "date", "season").dropDuplicates(["_match"])
    r = read_table(spark, d, "brownlow_player_records").join(of, F.col("matchid") == F.col("_match"), "left").select(F.col("record_id").alias("vote_id"), "date", F.col("teamid").alias("team_id"), F.col("givenname").alias("given"), "surname", "season")
    names = read_table(spark, d, "players").select(F.col("id").alias("player_id"), F.col("first_name").alias("given"), "surname")
    lines = read_table(spark, d, "player_match_stats").where("player_id <> 1").select("match_id", "team_id", "player_id").distinct()
    players = lines.join(names, "player_id").join(matches.select("match_id", "season"), "match_id")
    return votes.resolve(r, matches, players).groupBy("outcome", "tier").agg(F.count("*").alias("n"))


def provider_names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct typed team names with the name they stand for and whether they are placeholders."""
    o = read_table(spark, d, "coach_observations").select("raw_team").distinct()
    return o.select("raw_team", labels.team_name(F.col("raw_team")).alias("team"), labels.is_placeholder(F.col("raw_team")).alias("placeholder"))


def quarantined(spark: SparkSession, d: str) -> DataFrame:
    """Observations whose team is a placeholder or holds no letter, and whether their page has rows left
    without them."""
    o = read_table(spark, d, "coach_observations").select("id", "provider", "external_match_id", "raw_team").distinct()
    held = o.where(labels.is_placeholder(F.trim("raw_team")) | ~F.coalesce(F.col("raw_team").rlike("[A-Za-z]{3}"), F.lit(False)))
    left = o.join(held.select("id"), "id", "left_anti").select("provider", "external_match_id").distinct().withColumn("page_left", F.lit(True))
    return held.join(left, ["provider", "external_match_id"], "left").select("id", F.coalesce("page_left", F.lit(False)).alias("page_left"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling hours of the events by type; the same function serves the stream."""
    return windowed(read_table(spark, d, "events"))


QUERIES = {f.__name__: f for f in (merge_deliveries, merge_affected, merge_insert_missing, replace_groups, merged_identity, constraints, numbered_rows, hourly_windows, hourly_windows_all, vote_lines, provider_names, quarantined, event_windows)}

_PICK = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY load_no DESC NULLS LAST) AS rn FROM player_match_stats WHERE load_no % 2 = {}) WHERE rn = 1)"
_MERGED = f"""
SELECT coalesce(n.id, o.id) AS id, coalesce(n.match_id, o.match_id) AS match_id, coalesce(n.player_id, o.player_id) AS player_id, {", ".join(f"coalesce(n.{c}, o.{c}) AS {c}" for c in MEASURES)},
  CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NOT NULL AND (o.match_id IS DISTINCT FROM n.match_id OR o.player_id IS DISTINCT FROM n.player_id OR {" OR ".join(f"coalesce(n.{c}, o.{c}) IS DISTINCT FROM o.{c}" for c in MEASURES)}) THEN 'updated' END AS _change
FROM {_PICK.format(1)} o FULL JOIN {_PICK.format(0)} n ON o.id = n.id"""
SQL = {
    "merge_deliveries": _MERGED,
    "merge_affected": f"WITH m AS ({_MERGED}) SELECT match_id FROM m WHERE _change IS NOT NULL UNION SELECT o.match_id FROM {_PICK.format(1)} o JOIN m ON m.id = o.id WHERE m._change IS NOT NULL",
    "merge_insert_missing": "SELECT DISTINCT c_nationkey AS k FROM customer UNION SELECT DISTINCT s_nationkey FROM supplier",
    "replace_groups": """SELECT id, match_id, player_id, is_emergency, is_substitute FROM match_lineups WHERE match_id NOT IN (SELECT match_id FROM match_lineups WHERE is_emergency = 0 AND is_substitute = 0)
  UNION ALL SELECT id, match_id, player_id, is_emergency, is_substitute FROM match_lineups WHERE is_emergency = 0 AND is_substitute = 0""",
    "merged_identity": """SELECT match_id, player_id, CASE WHEN count(DISTINCT team_id) = 1 THEN max(team_id) END AS team_id, CASE WHEN count(DISTINCT guernsey_number) = 1 THEN max(guernsey_number) END AS guernsey_number,
  CAST((count(DISTINCT team_id) > 1) AS INT) + CAST((count(DISTINCT guernsey_number) > 1) AS INT) AS n_conflicts FROM match_lineups GROUP BY 1, 2""",
    "constraints": """SELECT * FROM (
  SELECT 'not null venue_id' AS "constraint", count(*) AS n FROM matches WHERE venue_id IS NULL UNION ALL SELECT 'not null status', count(*) FROM matches WHERE status IS NULL
  UNION ALL SELECT 'unique id', count(*) FROM (SELECT id FROM matches GROUP BY id HAVING count(*) > 1)
  UNION ALL SELECT 'unique external_afl_id', count(*) FROM (SELECT external_afl_id FROM matches WHERE external_afl_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'one of round_type', count(*) FROM matches WHERE round_type NOT IN ('Regular', 'Finals') UNION ALL SELECT 'one of completed_quarter', count(*) FROM matches WHERE completed_quarter NOT IN (0, 1, 2, 3, 4)
  UNION ALL SELECT 'parent of home_team_id', count(*) FROM matches WHERE home_team_id NOT IN (SELECT id FROM teams) UNION ALL SELECT 'parent of venue_id', count(*) FROM matches WHERE venue_id NOT IN (SELECT id FROM venues)) WHERE n > 0""",
    "numbered_rows": "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY c_custkey) AS o_orderkey FROM customer",
    "hourly_windows": """
WITH h AS (SELECT event_type AS series, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) AS n, max(value) AS g FROM events GROUP BY 1, 2),
t AS (SELECT series || '@' || hour AS id, series, hour AS start FROM h)
SELECT t.id, CASE WHEN count(*) FILTER (WHERE h.hour >= start) = 3 THEN CAST(sum(n) FILTER (WHERE h.hour >= start) AS DOUBLE) END AS precip,
  CASE WHEN count(*) FILTER (WHERE h.hour < start) = 24 THEN CAST(sum(n) FILTER (WHERE h.hour < start) AS DOUBLE) END AS prior_precip,
  CASE WHEN count(*) FILTER (WHERE h.hour >= start) = 3 THEN round(max(g) FILTER (WHERE h.hour >= start), 2) END AS gust
FROM t JOIN h ON h.series = t.series AND h.hour BETWEEN start - 24 * 3600 AND start + 2 * 3600 GROUP BY t.id""",
    "quarantined": r"""WITH o AS (SELECT DISTINCT id, provider, external_match_id, raw_team FROM coach_observations),
  h AS (SELECT * FROM o WHERE regexp_matches(trim(raw_team), '^\d{1,2}(st|nd|rd|th)$|^(winner|loser) of\b|-ranked\b.*\b(winner|loser)$|^(tbc|tba|to be confirmed)$', 'i') OR NOT coalesce(regexp_matches(raw_team, '[A-Za-z]{3}'), false))
  SELECT id, EXISTS (SELECT 1 FROM o WHERE o.provider = h.provider AND o.external_match_id = h.external_match_id AND o.id NOT IN (SELECT id FROM h)) AS page_left FROM h""",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
