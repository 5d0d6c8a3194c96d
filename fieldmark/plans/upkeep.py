"""Queries that run the operators of :mod:`fieldmark.operators.sync` over the snapshot's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators import sync, upsert
from fieldmark.plans import operations
from fieldmark.sources import read_table

# Corrections of names as (key, expected, corrected); the last one no longer applies.
CORRECTIONS = ((0, "NATION_0", "Algeria"), (3, "NATION_3", "Canada"), (7, "NATION_999", "Germany"))


def match_identity(spark: SparkSession, d: str) -> DataFrame:
    """Every match as delivered, found among the complete ones by external id, else by day and teams."""
    m = read_table(spark, d, "matches").select("id", "external_afl_id", "date", "home_team_id", "away_team_id", "status", "load_no")
    # what was delivered first is known under its external id only where that was stated
    old = m.where("status = 'Complete'")
    return sync.identify(m, old, "external_afl_id", ["date", "home_team_id", "away_team_id"]).select("id", "found", "stage")


def match_dated(spark: SparkSession, d: str) -> DataFrame:
    """Matches known by id only, updated by their delivery: an undated one gives its state alone."""
    new = read_table(spark, d, "matches").select("id", "date", "round", "status", "kickoff_at")
    old = new.select("id", F.lit(None).cast("string").alias("date"), F.lit("R0").alias("round"), F.lit("Scheduled").alias("status"), F.lit(None).cast("string").alias("kickoff_at"))
    key, state = upsert.Rule("id", "key"), [upsert.Rule("status"), upsert.Rule("kickoff_at")]
    dated = upsert.merge(old, new.where("date is not null"), [key, upsert.Rule("date"), upsert.Rule("round"), *state]).drop("_change")
    return upsert.merge(dated, new.where("date is null"), [key, *state])


def stats_admitted(spark: SparkSession, d: str) -> DataFrame:
    """Statistic lines admitted by match: of known players and matches, without the idle ones that no line-up lists."""
    s = read_table(spark, d, "player_match_stats").select("id", "match_id", "player_id", "team_id", "time_on_ground_pct", "disposals")
    known = {"player_id": read_table(spark, d, "players").where("surname is not null").select("id"), "match_id": read_table(spark, d, "matches").select("id"), "team_id": read_table(spark, d, "teams").select("id")}
    listed = read_table(spark, d, "match_lineups").select("match_id", "player_id")
    idle = F.expr("coalesce(time_on_ground_pct, 0) = 0 AND coalesce(disposals, 0) < 3")
    return sync.admitted(s, listed, known, ["match_id", "player_id"], idle).groupBy("match_id").agg(F.count("*").alias("n"))


def lineup_faults(spark: SparkSession, d: str) -> DataFrame:
    """Each team's line-up with what speaks against replacing the old one by it."""
    rows = read_table(spark, d, "match_lineups").select("match_id", "team_id", "player_id", "is_emergency")
    return sync.snapshot_faults(rows, ["match_id", "team_id"], "player_id", read_table(spark, d, "players").select("id"), (21, 23), F.col("is_emergency") == 0)


def lineup_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Line-up places by match, those of the statistics replaced by each valid line-up."""
    old = read_table(spark, d, "player_match_stats").select("match_id", "team_id", "player_id").distinct()
    valid = lineup_faults(spark, d).where("valid").select("match_id", "team_id")
    new = read_table(spark, d, "match_lineups").where("is_emergency = 0").select("match_id", "team_id", "player_id").distinct().join(valid, ["match_id", "team_id"])
    return upsert.replace_groups(old, new, ["match_id", "team_id"]).groupBy("match_id").agg(F.count("*").alias("n"), F.sum("player_id").alias("ids"))


def new_players(spark: SparkSession, d: str) -> DataFrame:
    """Names of vote records that no player has, as new players numbered after the last one."""
    p, v = read_table(spark, d, "players").select("id", "first_name", "surname"), read_table(spark, d, "brownlow_player_records")
    names = v.where("givenname is not null AND surname is not null").select(F.col("givenname").alias("first_name"), "surname").distinct()
    return upsert.with_keys(p, names.join(p.select("first_name", "surname").distinct(), ["first_name", "surname"], "left_anti"), "id", ["surname", "first_name"])


def names_corrected(spark: SparkSession, d: str) -> DataFrame:
    """Nations with verified corrections, each applied only where the expected name still stands."""
    c = spark.createDataFrame(list(CORRECTIONS), "n_nationkey long, expected string, corrected string")
    return sync.corrected(read_table(spark, d, "nation").select("n_nationkey", "n_name"), c, ["n_nationkey"], "n_name")


def points_assigned(spark: SparkSession, d: str) -> DataFrame:
    """Matches with the points of their mirror image: both columns from one row at once."""
    m = read_table(spark, d, "matches").select("id", "home_points", "away_points")
    swapped = m.where("home_points > away_points").select("id", F.col("away_points").alias("home_points"), F.col("home_points").alias("away_points"))
    return sync.assigned(m, swapped, ["id"], ["home_points", "away_points"])


def team_rekeyed(spark: SparkSession, d: str) -> DataFrame:
    """Rows by table and team after team 1 became team 9001 from 2019 on, in every table that names teams."""
    year = read_table(spark, d, "matches").select(F.col("id").alias("match_id"), (F.col("season_id") % 10000).alias("_year"))
    out = None
    for table, key, columns in (("matches", "id", ("home_team_id", "away_team_id")), ("player_match_stats", "match_id", ("team_id",)), ("match_lineups", "match_id", ("team_id",)), ("coach_observations", "match_id", ("team_id",)), ("brownlow_player_records", "matchid", ("teamid",))):
        df = read_table(spark, d, table).select(F.col(key).alias("match_id"), *columns).join(year, "match_id", "left")
        moved = sync.rekeyed(df, list(columns), 1, 9001, F.col("_year") >= 2019)
        part = moved.select(F.explode(F.array(*columns)).alias("team_id")).where("team_id is not null").groupBy("team_id").agg(F.count("*").alias("n")).select(F.lit(table).alias("table_name"), "team_id", "n")
        out = part if out is None else out.unionByName(part)
    return out


def line_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Statistic lines with their revision after the even deliveries were merged into the odd ones."""
    old, _ = operations._deliveries(spark, d)
    return sync.revised(old.select("id", F.lit(1).alias("revision")), operations.merge_deliveries(spark, d), "id")


def seasons_affected(spark: SparkSession, d: str) -> DataFrame:
    """Seasons to be rebuilt because a line of theirs changed, or left for another match."""
    m = read_table(spark, d, "matches").select(F.col("id").alias("match_id"), "season_id")
    return operations.merge_affected(spark, d).join(m, "match_id").select("season_id").distinct()


def weather_valid(spark: SparkSession, d: str) -> DataFrame:
    """Weather rows left after kickoffs were replaced by the day and local time: those of matches whose
    time or venue changed are gone."""
    m = read_table(spark, d, "matches").select("id", F.substring("kickoff_at", 1, 10).alias("day"), "venue_id")
    new = read_table(spark, d, "matches").select("id", F.substring("date", 1, 10).alias("day"), F.coalesce("venue_id", F.lit(1)).alias("venue_id"))
    return sync.invalidated(read_table(spark, d, "match_weather").select("match_id", "kind", "source", "fetched_at"), m, new, "id", ["day", "venue_id"], "match_id")


def coach_statuses(spark: SparkSession, d: str) -> DataFrame:
    """What comes of each coach observation that states its match."""
    return sync.reconciled(read_table(spark, d, "coach_observations"), read_table(spark, d, "matches"))


def lineups_pruned(spark: SparkSession, d: str) -> DataFrame:
    """Line-up places that the statistics of their match, where there are any, confirm."""
    l_ = read_table(spark, d, "match_lineups").select("id", "match_id", "player_id")
    return sync.pruned(l_, read_table(spark, d, "player_match_stats").select("match_id", "player_id"), ["match_id"], ["player_id"])


def events_retained(spark: SparkSession, d: str) -> DataFrame:
    """Events of the last ten days before the end of January."""
    return sync.retained(read_table(spark, d, "events").select("event_id", "ts"), "ts", "2024-01-31 00:00:00", 10).select("event_id")


def venues_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Matches and names left when grounds with a roof are deleted, with all that refers to them."""
    v = read_table(spark, d, "venues")
    children = {"matches": (read_table(spark, d, "matches").select("id", "venue_id"), "venue_id"), "venues": (v.select("id", F.col("canonical_venue_id").alias("venue_id")), "venue_id")}
    left = sync.cascaded(v.where("roof <> 'none'"), children)
    parts = [t.select(F.lit(name).alias("table_name"), "id") for name, t in left.items()]
    return parts[0].unionByName(parts[1])


def refresh_left(spark: SparkSession, d: str) -> DataFrame:
    """For each season how many of its played matches still await their weather, and the first of them."""
    m = read_table(spark, d, "matches").where("status = 'Complete'").select(F.col("id").alias("match_id"), "season_id")
    seen = read_table(spark, d, "match_weather").where("kind = 'observed' AND temp_c is not null").select("match_id").distinct().withColumn("_seen", F.lit(True))
    return m.join(seen, "match_id", "left").groupBy("season_id").agg(F.count("*").alias("n"), F.count_if(F.col("_seen").isNull()).alias("remaining"), F.min(F.when(F.col("_seen").isNull(), F.col("match_id"))).alias("next_match"))


QUERIES = {f.__name__: f for f in (match_identity, match_dated, stats_admitted, lineup_faults, lineup_snapshot, new_players, names_corrected, points_assigned, team_rekeyed, line_revisions, seasons_affected, weather_valid, coach_statuses, lineups_pruned, events_retained, venues_deleted, refresh_left)}

_FAULTS = "SELECT match_id, team_id, CAST(sum(c) AS BIGINT) AS listed, count(*) FILTER (WHERE n > 1) AS twice, count(*) FILTER (WHERE player_id NOT IN (SELECT id FROM players)) AS unknown FROM (SELECT match_id, team_id, player_id, count(*) AS n, max(CAST(is_emergency = 0 AS INT)) AS c FROM match_lineups GROUP BY 1, 2, 3) GROUP BY 1, 2"
_VALID = f"SELECT *, listed BETWEEN 21 AND 23 AND twice = 0 AND unknown = 0 AS valid FROM ({_FAULTS})"
_REKEYED = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CASE WHEN t.{c} = 1 AND m.season_id % 10000 >= 2019 THEN 9001 ELSE t.{c} END AS team_id FROM {t} t LEFT JOIN matches m ON m.id = t.{k} WHERE t.{c} IS NOT NULL"
    for t, k, cs in (("matches", "id", ("home_team_id", "away_team_id")), ("player_match_stats", "match_id", ("team_id",)), ("match_lineups", "match_id", ("team_id",)), ("coach_observations", "match_id", ("team_id",)), ("brownlow_player_records", "matchid", ("teamid",)))
    for c in cs
)
SQL = {
    "match_identity": """WITH old AS (SELECT * FROM matches WHERE status = 'Complete'), x AS (SELECT external_afl_id, min(id) AS by_id FROM old WHERE external_afl_id IS NOT NULL GROUP BY 1),
  f AS (SELECT m.id, m.date, m.home_team_id, m.away_team_id, by_id FROM matches m LEFT JOIN x USING (external_afl_id)),
  n AS (SELECT date, home_team_id, away_team_id, min(id) AS by_natural FROM old WHERE id NOT IN (SELECT by_id FROM f WHERE by_id IS NOT NULL) AND date IS NOT NULL AND home_team_id IS NOT NULL AND away_team_id IS NOT NULL GROUP BY 1, 2, 3)
  SELECT f.id, coalesce(by_id, by_natural) AS found, CASE WHEN by_id IS NOT NULL THEN 'external' WHEN by_natural IS NOT NULL THEN 'natural' ELSE 'new' END AS stage FROM f LEFT JOIN n USING (date, home_team_id, away_team_id)""",
    "match_dated": "SELECT id, date, CASE WHEN date IS NULL THEN 'R0' ELSE coalesce(round, 'R0') END AS round, coalesce(status, 'Scheduled') AS status, kickoff_at, CASE WHEN date IS NULL AND (coalesce(status, 'Scheduled') <> 'Scheduled' OR kickoff_at IS NOT NULL) THEN 'updated' END AS _change FROM matches",
    "stats_admitted": """SELECT match_id, count(*) AS n FROM player_match_stats s WHERE player_id IN (SELECT id FROM players WHERE surname IS NOT NULL) AND match_id IN (SELECT id FROM matches) AND team_id IN (SELECT id FROM teams)
  AND (NOT (coalesce(time_on_ground_pct, 0) = 0 AND coalesce(disposals, 0) < 3) OR EXISTS (SELECT 1 FROM match_lineups l WHERE l.match_id = s.match_id AND l.player_id = s.player_id)) GROUP BY 1""",
    "lineup_faults": _VALID,
    "lineup_snapshot": f"""WITH v AS (SELECT match_id, team_id FROM ({_VALID}) WHERE valid), r AS (SELECT DISTINCT match_id, team_id, player_id FROM player_match_stats WHERE (match_id, team_id) NOT IN (SELECT match_id, team_id FROM v)
  UNION ALL SELECT DISTINCT l.match_id, l.team_id, l.player_id FROM match_lineups l JOIN v USING (match_id, team_id) WHERE is_emergency = 0) SELECT match_id, count(*) AS n, CAST(sum(player_id) AS BIGINT) AS ids FROM r GROUP BY 1""",
    "new_players": """WITH n AS (SELECT DISTINCT givenname AS first_name, surname FROM brownlow_player_records WHERE givenname IS NOT NULL AND surname IS NOT NULL) SELECT first_name, surname, (SELECT max(id) FROM players) + row_number() OVER (ORDER BY surname, first_name) AS id
  FROM n WHERE NOT EXISTS (SELECT 1 FROM players p WHERE p.first_name = n.first_name AND p.surname = n.surname)""",
    "names_corrected": "SELECT n_nationkey, CASE " + " ".join(f"WHEN n_nationkey = {k} AND n_name = '{e}' THEN '{c}'" for k, e, c in CORRECTIONS) + " ELSE n_name END AS n_name FROM nation",
    "points_assigned": "SELECT id, CASE WHEN home_points > away_points THEN away_points ELSE home_points END AS home_points, CASE WHEN home_points > away_points THEN home_points ELSE away_points END AS away_points FROM matches",
    "team_rekeyed": f"SELECT table_name, team_id, count(*) AS n FROM ({_REKEYED}) GROUP BY 1, 2",
    "line_revisions": f"SELECT id, CASE WHEN _change = 'updated' THEN 2 ELSE 1 END AS revision FROM ({operations.SQL['merge_deliveries']})",
    "seasons_affected": f"SELECT DISTINCT season_id FROM matches WHERE id IN (SELECT match_id FROM ({operations.SQL['merge_affected']}))",
    "weather_valid": "SELECT match_id, kind, source, fetched_at FROM match_weather WHERE match_id NOT IN (SELECT id FROM matches WHERE substr(kickoff_at, 1, 10) IS DISTINCT FROM substr(date, 1, 10) OR venue_id IS DISTINCT FROM coalesce(venue_id, 1))",
    "coach_statuses": """WITH o AS (SELECT DISTINCT id, provider, match_id, team_id, home_points, away_points, external_coach_id FROM coach_observations WHERE match_id IS NOT NULL),
  c AS (SELECT provider, match_id, team_id, count(DISTINCT coalesce(external_coach_id, '')) AS n FROM o GROUP BY 1, 2, 3)
  SELECT o.id, CASE WHEN m.id IS NULL THEN 'unknown-match' WHEN coalesce(o.team_id NOT IN (m.home_team_id, m.away_team_id), false) THEN 'invalid-participant'
    WHEN coalesce(NOT (o.home_points = m.home_points AND o.away_points = m.away_points OR o.home_points = m.away_points AND o.away_points = m.home_points), false) THEN 'score-mismatch' WHEN c.n > 1 THEN 'duplicate' ELSE 'assigned' END AS status
  FROM o LEFT JOIN matches m ON m.id = o.match_id LEFT JOIN c ON c.provider IS NOT DISTINCT FROM o.provider AND c.match_id = o.match_id AND c.team_id IS NOT DISTINCT FROM o.team_id""",
    "lineups_pruned": "SELECT id, match_id, player_id FROM match_lineups WHERE match_id NOT IN (SELECT match_id FROM player_match_stats) OR (match_id, player_id) IN (SELECT match_id, player_id FROM player_match_stats)",
    "events_retained": "SELECT event_id FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-21 00:00:00'",
    "venues_deleted": "SELECT 'matches' AS table_name, id FROM matches WHERE venue_id IS NULL OR venue_id NOT IN (SELECT id FROM venues WHERE roof <> 'none') UNION ALL SELECT 'venues', id FROM venues WHERE canonical_venue_id IS NULL OR canonical_venue_id NOT IN (SELECT id FROM venues WHERE roof <> 'none')",
    "refresh_left": "WITH s AS (SELECT DISTINCT match_id FROM match_weather WHERE kind = 'observed' AND temp_c IS NOT NULL) SELECT season_id, count(*) AS n, count(*) FILTER (WHERE id NOT IN (SELECT match_id FROM s)) AS remaining, min(id) FILTER (WHERE id NOT IN (SELECT match_id FROM s)) AS next_match FROM matches WHERE status = 'Complete' GROUP BY 1",
}
