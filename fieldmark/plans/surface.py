"""The public SQL surface: statements as callers write them, in SQLite's form, prepared and bound.

Each entry is a statement with its values, run through :class:`fieldmark.plans.statement.Catalog`, and
its form in DuckDB.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from fieldmark.plans.statement import Catalog

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "matches", "players", "player_match_stats", "match_lineups", "match_weather", "venues", "teams", "coach_observations")
#: The clock's value that the statements see.
NOW = "2024-02-15 06:30:00"
_COMPLETE = "season_id, count(*) AS n, CASE WHEN count(*) > 0 AND {} = 0 THEN 1 ELSE 0 END AS complete FROM matches GROUP BY season_id"
_LEAST = "CASE WHEN {0} IS NULL THEN NULL ELSE coalesce(TRY_CAST(regexp_extract({0}, '^\\s*([+-]?\\d+)', 1) AS BIGINT), 0) END"
_FETCHED = "SELECT match_id, kind, max(fetched_at) AS seen FROM match_weather GROUP BY match_id, kind"

#: name: (statement, values, DuckDB's form).
STATEMENTS: dict[str, tuple[str, tuple, str]] = {
    # statements and their values
    "sql_all": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > ?1 AND o_orderstatus = ?2", (100000.0, "F"), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'"),
    "sql_first": ("SELECT id, surname FROM players ORDER BY surname, id LIMIT 1", (), "SELECT id, surname FROM players ORDER BY surname NULLS FIRST, id LIMIT 1"),
    "sql_rebound": ("SELECT n_name FROM nation WHERE n_regionkey = ? AND n_nationkey > ?", (1, 2), "SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 2"),
    "sql_optional": ("SELECT o_orderkey FROM orders WHERE (?1 IS NULL OR o_orderstatus = ?1) AND (?2 IS NULL OR o_orderpriority = ?2)", ("F", None), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "sql_parameter_row": ("WITH pick AS (SELECT ?1 AS competition, ?2 AS year) SELECT m.id, m.round FROM pick JOIN matches m ON m.season_id = pick.competition * 10000 + pick.year", (1, 2018), "SELECT id, round FROM matches WHERE season_id = 12018"),
    "sql_json_each": ("SELECT p.id, p.surname FROM players p WHERE p.id IN (SELECT value FROM json_each(?1))", ("[1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233]",), "SELECT id, surname FROM players WHERE id IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233)"),
    "sql_json_lateral": ("SELECT n.n_nationkey, j.key AS k, j.value AS v FROM nation n, json_each('[' || n.n_regionkey || ', ' || n.n_nationkey || ']') AS j", (), "SELECT n_nationkey, unnest([0, 1]) AS k, unnest([CAST(n_regionkey AS VARCHAR), CAST(n_nationkey AS VARCHAR)]) AS v FROM nation"),
    "sql_json_length": ("SELECT id, json_array_length('[' || coalesce(home_points || ',' || away_points, '') || ']') AS n FROM matches", (), "SELECT id, CAST(json_array_length('[' || coalesce(home_points || ',' || away_points, '') || ']') AS INT) AS n FROM matches"),
    "sql_json_valid": ("SELECT event_id, json_valid(props) AS whole, json_valid(event_type) AS part FROM events", (), "SELECT event_id, CAST(json_valid(props) AS INT) AS whole, CAST(json_valid(event_type) AS INT) AS part FROM events"),
    # projection and predicates
    "sql_star": ("SELECT *, n_nationkey * 10 AS tenfold FROM nation", (), "SELECT *, n_nationkey * 10 AS tenfold FROM nation"),
    "sql_glob": ("SELECT id FROM players WHERE surname GLOB '[A-M]*e?' AND first_name GLOB 'J*'", (), "SELECT id FROM players WHERE surname GLOB '[A-M]*e?' AND first_name GLOB 'J*'"),
    "sql_regexp": ("SELECT id FROM players WHERE surname REGEXP '^[A-M].*(er|ax)$'", (), "SELECT id FROM players WHERE regexp_matches(surname, '^[A-M].*(er|ax)$')"),
    "sql_collate": ("SELECT first_name COLLATE NOCASE AS name, count(*) AS n FROM (SELECT lower(first_name) AS first_name FROM players) x WHERE first_name = 'PETER' COLLATE NOCASE GROUP BY name", (), "SELECT lower(first_name) AS name, count(*) AS n FROM players WHERE lower(first_name) = 'peter' GROUP BY 1"),
    "sql_row_compare": ("SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) > (1, 8)", (), "SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) > (1, 8)"),
    "sql_is_value": ("SELECT id FROM matches WHERE status IS NOT 'Complete' AND round_type IS 'Regular'", (), "SELECT id FROM matches WHERE status IS DISTINCT FROM 'Complete' AND round_type = 'Regular'"),
    "sql_dates": ("SELECT id FROM matches WHERE substr(date, 1, 10) >= ?1 AND substr(date, 1, 10) < ?2", ("2018-01-01", "2027-01-01"), "SELECT id FROM matches WHERE substr(date, 1, 10) >= '2018-01-01' AND substr(date, 1, 10) < '2027-01-01'"),
    # joins, aggregates
    "sql_natural": ("SELECT n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region)", (), "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "sql_right": ("SELECT c_custkey, n_name FROM (SELECT * FROM customer WHERE c_acctbal > 9000) RIGHT JOIN nation ON c_nationkey = n_nationkey", (), "SELECT c_custkey, n_name FROM (SELECT * FROM customer WHERE c_acctbal > 9000) RIGHT JOIN nation ON c_nationkey = n_nationkey"),
    "sql_sum_condition": ("SELECT status, SUM(margin > 0) AS home_wins, SUM(attendance IS NULL) AS unknown FROM matches GROUP BY status", (), "SELECT status, CAST(sum(CAST(margin > 0 AS INT)) AS BIGINT) AS home_wins, CAST(sum(CAST(attendance IS NULL AS INT)) AS BIGINT) AS unknown FROM matches GROUP BY status"),
    "sql_bare_columns": ("SELECT t.name, t.abbreviation, count(*) AS n FROM matches m JOIN teams t ON t.id = m.home_team_id GROUP BY t.id", (), "SELECT t.name, t.abbreviation, count(*) AS n FROM matches m JOIN teams t ON t.id = m.home_team_id GROUP BY t.id, t.name, t.abbreviation"),
    "sql_total": ("SELECT status, total(coalesce(home_points, 0)) AS points, total(nullif(margin, margin)) AS none FROM matches GROUP BY status", (), "SELECT status, CAST(sum(coalesce(home_points, 0)) AS DOUBLE) AS points, CAST(0 AS DOUBLE) AS none FROM matches GROUP BY status"),
    "sql_season_complete": (f"SELECT {_COMPLETE.format('SUM(status IS NULL OR status NOT IN (?1, ?2))')}", ("Complete", "Cancelled"), "SELECT " + _COMPLETE.format("count(*) FILTER (WHERE status IS NULL OR status NOT IN ('Complete', 'Cancelled'))")),
    # order, limit, subqueries
    "sql_distinct_top": ("SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 50000 ORDER BY o_custkey LIMIT 15", (), "SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 50000 ORDER BY o_custkey LIMIT 15"),
    "sql_least_recent": ("SELECT source, max(fetched_at) AS last FROM match_weather GROUP BY source ORDER BY max(fetched_at), source LIMIT 1", (), "SELECT source, max(fetched_at) AS last FROM match_weather GROUP BY source ORDER BY max(fetched_at) NULLS FIRST, source NULLS FIRST LIMIT 1"),
    "sql_stale_first": (f"SELECT match_id, kind, seen FROM ({_FETCHED}) f WHERE seen < ?1 ORDER BY seen, match_id, kind LIMIT 25", ("2025-01-01",), f"SELECT match_id, kind, seen FROM ({_FETCHED}) f WHERE seen < '2025-01-01' ORDER BY seen, match_id, kind LIMIT 25"),
    "sql_not_exists_column": ("SELECT c_custkey, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > ?1) AS idle FROM customer", (200000.0,), "SELECT c_custkey, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS idle FROM customer"),
    "sql_nested_exists": (
        "SELECT m.id FROM matches m WHERE m.status = 'Complete' AND EXISTS (SELECT 1 FROM player_match_stats s WHERE s.match_id = m.id AND (s.goals IS NULL OR s.behinds IS NULL)) AND EXISTS (SELECT 1 FROM match_lineups l WHERE l.match_id = m.id AND EXISTS (SELECT 1 FROM players p WHERE p.id = l.player_id AND (p.height_cm IS NULL OR p.weight_kg > 90)))", (),
        "SELECT m.id FROM matches m WHERE m.status = 'Complete' AND EXISTS (SELECT 1 FROM player_match_stats s WHERE s.match_id = m.id AND (s.goals IS NULL OR s.behinds IS NULL)) AND EXISTS (SELECT 1 FROM match_lineups l WHERE l.match_id = m.id AND EXISTS (SELECT 1 FROM players p WHERE p.id = l.player_id AND (p.height_cm IS NULL OR p.weight_kg > 90)))",
    ),
    "sql_due": ("SELECT match_id, kind, fetched_at FROM match_weather WHERE fetched_at <= strftime('%Y-%m-%dT%H:%M:%SZ', 'now', '+1 year') AND kind = ?1 ORDER BY fetched_at, match_id, source, temp_c LIMIT 20", ("forecast",), "SELECT match_id, kind, fetched_at FROM match_weather WHERE fetched_at <= '2025-02-15T06:30:00Z' AND kind = 'forecast' ORDER BY fetched_at NULLS FIRST, match_id, source NULLS FIRST, temp_c NULLS FIRST LIMIT 20"),
    # casts, quotients, times
    "sql_casts": ("SELECT id, CAST(date AS INTEGER) AS leading, CAST(local_time AS INTEGER) AS hour, CAST(attendance AS TEXT) AS a FROM matches", (), f"SELECT id, {_LEAST.format('date')} AS leading, {_LEAST.format('local_time')} AS hour, CAST(attendance AS VARCHAR) AS a FROM matches"),
    "sql_quotients": ("SELECT id, home_points / away_behinds AS whole, 1.0 * home_points / away_behinds AS part, season_id / 10000 AS competition FROM matches", (), "SELECT id, CAST(home_points // nullif(away_behinds, 0) AS DOUBLE) AS whole, CAST(home_points AS DOUBLE) / nullif(away_behinds, 0) AS part, CAST(season_id // 10000 AS DOUBLE) AS competition FROM matches"),
    "sql_times": ("SELECT event_id, strftime('%Y-%m-%dT%H:%M:%SZ', ts, '+1 day') AS later, date(ts, 'start of month') AS month, datetime(ts, '-90 minutes') AS earlier FROM events", (), "SELECT event_id, strftime(ts + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ') AS later, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, strftime(ts - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS earlier FROM events"),
    "sql_recent": ("SELECT event_id FROM events WHERE ts >= datetime('now', '-20 days')", (), "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-26 06:30:00'"),
    "sql_id_date": (r"SELECT id, regexp_replace(external_afl_id, '^.*([0-9]{4})([0-9]{2})([0-9]{2})$', '$1-$2-$3') AS day FROM matches WHERE external_afl_id IS NOT NULL", (), r"SELECT id, regexp_replace(external_afl_id, '^.*([0-9]{4})([0-9]{2})([0-9]{2})$', '\1-\2-\3') AS day FROM matches WHERE external_afl_id IS NOT NULL"),
    "sql_scalar_max": ("SELECT id, max(home_points, away_points) AS more, ifnull(venue_id, -1) AS venue, iif(margin > 0, 'home', 'other') AS side FROM matches", (), "SELECT id, CASE WHEN home_points IS NULL OR away_points IS NULL THEN NULL ELSE greatest(home_points, away_points) END AS more, coalesce(venue_id, -1) AS venue, CASE WHEN margin > 0 THEN 'home' ELSE 'other' END AS side FROM matches"),
}
_BATCH = ("SELECT 'matches' AS t, count(*) AS n FROM matches", "SELECT 'players', count(*) FROM players", "SELECT 'unlisted', count(*) FROM matches m WHERE NOT EXISTS (SELECT 1 FROM match_lineups l WHERE l.match_id = m.id)")


def query(name: str):
    statement, values, _ = STATEMENTS[name]

    def run(spark: SparkSession, directory: str) -> DataFrame:
        # an earlier binding is replaced as a whole
        return Catalog(spark, directory, TABLES, NOW).prepare(statement).bind(*[None] * len(values)).bind(*values).frame()

    run.__name__ = name
    return run


def sql_batch(spark: SparkSession, directory: str) -> DataFrame:
    """Several statements on one snapshot, as one job."""
    c = Catalog(spark, directory, TABLES, NOW)
    return reduce(DataFrame.union, [c.prepare(s).frame() for s in _BATCH])


QUERIES = {name: query(name) for name in STATEMENTS} | {"sql_batch": sql_batch}
SQL = {name: s[2] for name, s in STATEMENTS.items()} | {"sql_batch": " UNION ALL ".join(_BATCH)}
