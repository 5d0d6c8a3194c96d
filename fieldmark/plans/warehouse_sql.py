"""DuckDB SQL of the warehouse queries, written from the definitions and not from the plans."""


M = "m AS (SELECT *, CAST(season_id // 10000 AS INT) AS competition_id, CAST(season_id % 10000 AS INT) AS year, CASE season_id // 10000 WHEN 1 THEN 'AFLM' WHEN 2 THEN 'AFLW' WHEN 3 THEN 'VFL' WHEN 4 THEN 'VFLW' END AS code FROM matches)"
S = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY load_no DESC NULLS LAST) AS rn FROM player_match_stats) WHERE rn = 1)"
INPUTS = ("goals", "behinds", "hitouts", "goal_assists", "inside_fifties", "marks_inside_fifty", "free_kicks_for", "free_kicks_against", "rebounds", "one_percenters", "marks", "clearances", "tackles")


def value_sql(require_complete: bool) -> str:
    known = "complete" if require_complete else "TRUE"
    nulls = " OR ".join(f"{c} IS NULL" for c in INPUTS)
    filled = ", ".join(f"coalesce({c}, 0) AS {c}" for c in INPUTS)
    return f"""
WITH {M}, {S},
p AS (SELECT * FROM m WHERE status = 'Complete' AND ((competition_id = 1 AND year >= 1998) OR (competition_id = 2 AND year >= 2017))),
i AS (SELECT match_id, team_id, sum(coalesce(inside_fifties, 0)) AS i50, bool_or({nulls}) AS broken FROM s GROUP BY 1, 2),
sides AS (SELECT id, season_id, home_team_id AS team_id, away_team_id AS other_id, home_points AS pf, away_points AS pa FROM p
  UNION ALL SELECT id, season_id, away_team_id, home_team_id, away_points, home_points FROM p),
j AS (SELECT x.*, a.i50, a.broken, b.i50 AS i50a FROM sides x LEFT JOIN i a ON a.match_id = x.id AND a.team_id = x.team_id LEFT JOIN i b ON b.match_id = x.id AND b.team_id = x.other_id),
done AS (SELECT season_id, count(*) FILTER (WHERE pf IS NULL OR pa IS NULL OR i50 IS NULL OR coalesce(broken, FALSE)) = 0 AS complete FROM j GROUP BY 1),
t AS (SELECT season_id, team_id, CAST(sum(pf) AS DOUBLE) AS pf, CAST(sum(pa) AS DOUBLE) AS pa, CAST(sum(i50) AS DOUBLE) AS i50, CAST(sum(i50a) AS DOUBLE) AS i50a FROM j
  WHERE pf IS NOT NULL AND pa IS NOT NULL AND i50 IS NOT NULL AND i50a IS NOT NULL GROUP BY 1, 2),
l AS (SELECT season_id, sum(pf) / nullif(sum(i50), 0) AS av, count(*) AS n FROM t GROUP BY 1),
r AS (SELECT t.season_id, team_id, n, pf / nullif(i50, 0) / nullif(av, 0) AS o, i50 / nullif(i50a, 0) AS mi, pa / nullif(i50a, 0) / nullif(av, 0) AS dn FROM t JOIN l USING (season_id)),
r2 AS (SELECT *, CASE WHEN dn <> 0 THEN 100 * (2 - dn) END AS de FROM r),
z AS (SELECT season_id, nullif(sum(o), 0) AS so, nullif(sum(mi), 0) AS sm, nullif(sum(de), 0) AS sd FROM r2 GROUP BY 1),
pool AS (SELECT r2.season_id, team_id, o / so * n * 100 AS po, mi / sm * n * 100 AS pm, de / sd * n * 100 AS pd FROM r2 JOIN z USING (season_id)),
f AS (SELECT p.season_id, s.team_id, s.player_id, {filled} FROM s JOIN p ON p.id = s.match_id WHERE time_on_ground_pct > 0 OR disposals > 0),
k AS (SELECT season_id, team_id, player_id,
  sum(6 * goals + behinds + 0.25 * hitouts + 3 * goal_assists + inside_fifties + marks_inside_fifty + free_kicks_for - free_kicks_against) AS o,
  sum(15 * inside_fifties + 20 * clearances + 3 * tackles + 1.5 * hitouts + free_kicks_for - free_kicks_against) AS mi,
  sum(20 * rebounds + 12 * one_percenters + marks - 4 * marks_inside_fifty + 2 * (free_kicks_for - free_kicks_against) - CAST(2 AS DOUBLE) / 3 * hitouts) AS de FROM f GROUP BY 1, 2, 3),
kt AS (SELECT season_id, team_id, nullif(CAST(sum(o) AS DOUBLE), 0) AS o_all, nullif(CAST(sum(mi) AS DOUBLE), 0) AS m_all, nullif(sum(de), 0) AS d_all FROM k GROUP BY 1, 2),
v AS (SELECT k.season_id, k.player_id, k.team_id, complete, o / o_all * po AS o, mi / m_all * pm AS mi, de / d_all * pd AS de FROM k JOIN kt USING (season_id, team_id) JOIN pool USING (season_id, team_id) JOIN done USING (season_id))
SELECT season_id, player_id, team_id, {", ".join(f"CASE WHEN {known} THEN CASE WHEN round({x}, 2) = 0 THEN 0 ELSE round({x}, 2) END END AS {name}_value" for x, name in (("o", "off"), ("mi", "mid"), ("de", "def"), ("o + mi + de", "total")))} FROM v"""


AUDIT = f"""
SELECT 'played-without-statistics' AS issue, CAST(id AS VARCHAR) AS record_id FROM matches m WHERE status = 'Complete' AND NOT EXISTS (SELECT 1 FROM player_match_stats p WHERE p.match_id = m.id)
UNION ALL SELECT DISTINCT 'listed-player-unknown', CAST(player_id AS VARCHAR) FROM match_lineups l WHERE NOT EXISTS (SELECT 1 FROM players p WHERE p.id = l.player_id)
UNION ALL SELECT DISTINCT 'statistics-of-unknown-match', CAST(match_id AS VARCHAR) FROM player_match_stats s WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.id = s.match_id)
UNION ALL SELECT DISTINCT 'value-unknown', CAST(player_id AS VARCHAR) FROM ({value_sql(True)}) WHERE total_value IS NULL"""

SQL = {
    "ladder": f"""
WITH {M}, x AS (SELECT code, year, home_team_id AS team_id, home_points AS pf, away_points AS pa, round_type, round_abbreviation, status FROM m
  UNION ALL SELECT code, year, away_team_id, away_points, home_points, round_type, round_abbreviation, status FROM m)
SELECT code, year, t.name AS team, count(*) AS played, count(*) FILTER (WHERE pf > pa) AS wins, count(*) FILTER (WHERE pf < pa) AS losses, count(*) FILTER (WHERE pf = pa) AS draws,
  CAST(sum(pf) AS BIGINT) AS points_for, CAST(sum(pa) AS BIGINT) AS points_against, round(100.0 * CAST(sum(pf) AS DOUBLE) / nullif(sum(pa), 0), 1) AS percentage,
  4 * count(*) FILTER (WHERE pf > pa) + 2 * count(*) FILTER (WHERE pf = pa) AS premiership_points
FROM x JOIN teams t ON t.id = x.team_id WHERE round_type = 'Regular' AND round_abbreviation IS DISTINCT FROM 'WC' AND status = 'Complete' GROUP BY code, year, t.id, t.name""",
    "match_names": f"""
WITH {M} SELECT m.id AS match_id, code, year, m.date, m.round, h.name AS home_team, a.name AS away_team, home_points, away_points, margin, v.name AS venue
FROM m JOIN teams h ON h.id = home_team_id JOIN teams a ON a.id = away_team_id JOIN venues v ON v.id = venue_id""",
    "grand_finals": f"""
WITH {M} SELECT code, year, m.id AS match_id, h.name AS home_team, a.name AS away_team, abs(margin) AS winning_margin FROM m JOIN teams h ON h.id = home_team_id JOIN teams a ON a.id = away_team_id
WHERE m.id IN (SELECT max(id) FROM m WHERE round_type = 'Finals' AND status = 'Complete' GROUP BY code, year)""",
    "career_arc": f"""
WITH {M}, {S} SELECT code, year, player_id, count(*) AS games, CAST(sum(disposals) AS BIGINT) AS total_disposals, CAST(sum(goals) AS BIGINT) AS total_goals FROM s JOIN m ON m.id = s.match_id GROUP BY 1, 2, 3""",
    "source_comparisons": """
WITH o AS (SELECT DISTINCT provider, CASE WHEN match_id IS NOT NULL THEN concat_ws('/', 'm', match_id, team_id) ELSE match_date || '/' || raw_team END AS slot, display_name, coach_id FROM coach_observations)
SELECT a.slot, a.display_name AS first_coach, b.display_name AS second_coach FROM o a JOIN o b ON a.slot = b.slot WHERE a.provider = 'afl-tables' AND b.provider = 'footywire' AND a.coach_id <> b.coach_id""",
    "lineup_changes": f"""
WITH {M}, l AS (SELECT DISTINCT season_id, team_id, match_id, player_id FROM match_lineups JOIN m ON m.id = match_id WHERE is_emergency = 0),
st AS (SELECT team_id, match_id, lag(match_id) OVER (PARTITION BY season_id, team_id ORDER BY match_id) AS previous_id FROM (SELECT DISTINCT season_id, team_id, match_id FROM l))
SELECT st.team_id, st.match_id, previous_id, player_id, 'IN' AS change FROM st JOIN l USING (team_id, match_id) WHERE previous_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM l b WHERE b.team_id = st.team_id AND b.match_id = previous_id AND b.player_id = l.player_id)
UNION ALL
SELECT st.team_id, st.match_id, previous_id, player_id, 'OUT' FROM st JOIN l ON l.team_id = st.team_id AND l.match_id = previous_id
WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.team_id = st.team_id AND b.match_id = st.match_id AND b.player_id = l.player_id)""",
    "wet_games": f"""
WITH {M}, w AS (SELECT DISTINCT match_id, precip_mm, precip_24h_prior_mm FROM match_weather WHERE kind = 'observed')
SELECT m.id AS match_id, year, h.name AS home_team, a.name AS away_team, home_points + away_points AS total_points, precip_mm, precip_24h_prior_mm
FROM m JOIN w ON w.match_id = m.id JOIN teams h ON h.id = home_team_id JOIN teams a ON a.id = away_team_id JOIN venues v ON v.id = venue_id JOIN venues c ON c.id = coalesce(v.canonical_venue_id, v.id)
WHERE m.status = 'Complete' AND precip_mm >= 2.0 AND c.roof = 'none'""",
    "tipping": f"""
WITH {M}, x AS (SELECT *, 6 * (home_q1_goals - away_q1_goals) + home_q1_behinds - away_q1_behinds AS g FROM m WHERE status = 'Complete' AND home_points IS NOT NULL AND away_points IS NOT NULL)
SELECT code, year, count(*) AS completed, count(g) AS predictions, count(*) FILTER (WHERE (g >= 0 AND home_points > away_points) OR (g < 0 AND away_points > home_points)) AS correct,
  count(*) FILTER (WHERE g IS NOT NULL AND home_points <> away_points) AS decisive, count(*) FILTER (WHERE g IS NOT NULL AND home_points = away_points) AS draws,
  round(avg(abs(g - (home_points - away_points))), 3) AS margin_mae,
  round(100.0 * CAST(count(*) FILTER (WHERE (g >= 0 AND home_points > away_points) OR (g < 0 AND away_points > home_points)) AS DOUBLE) / nullif(count(*) FILTER (WHERE g IS NOT NULL AND home_points <> away_points), 0), 3) AS accuracy_pct
FROM x GROUP BY 1, 2""",
    "integrity_margin": "SELECT id AS match_id, home_points, away_points, margin FROM matches WHERE margin <> home_points - away_points",
    "integrity_match_points": "SELECT id AS match_id, home_points, away_points FROM matches WHERE home_points <> home_goals * 6 + home_behinds OR away_points <> away_goals * 6 + away_behinds",
    "integrity_quarter_scores": "SELECT id AS match_id FROM matches WHERE home_q1_goals IS NOT NULL AND (" + " OR ".join(f"{s}_{k} <> {' + '.join(f'{s}_q{q}_{k}' for q in range(1, 5))}" for s in ("home", "away") for k in ("goals", "behinds")) + ")",
    "integrity_disposals": f"WITH {S} SELECT id AS row_id, match_id, player_id, kicks, handballs, disposals FROM s WHERE disposals <> kicks + handballs",
    "integrity_clearances": f"WITH {S} SELECT id AS row_id, match_id, player_id, centre_clearances, stoppage_clearances, clearances FROM s WHERE clearances <> centre_clearances + stoppage_clearances",
    "integrity_votes": f"WITH {S}, x AS (SELECT match_id, CAST(sum(brownlow_votes) AS BIGINT) AS total FROM s GROUP BY 1) SELECT x.match_id, total FROM x JOIN matches m ON m.id = x.match_id WHERE m.round_type = 'Regular' AND total > 0 AND total <> 6",
    "season_value": value_sql(True),
    "season_value_known": value_sql(False),
    "match_inventory": f"""
WITH {M} SELECT code, year, count(*) AS n_matches, count(*) FILTER (WHERE status = 'Complete') AS played, count(*) FILTER (WHERE status = 'Cancelled') AS cancelled,
  count(*) FILTER (WHERE status IS NULL OR status NOT IN ('Complete', 'Cancelled')) AS unsettled, count(*) FILTER (WHERE id IN (SELECT match_id FROM player_match_stats)) AS with_statistics,
  count(*) FILTER (WHERE id IN (SELECT match_id FROM match_lineups)) AS with_lineups, count(*) FILTER (WHERE id IN (SELECT match_id FROM match_weather WHERE kind = 'observed')) AS with_weather FROM m GROUP BY 1, 2""",
    "audit": AUDIT,
    "audit_page": f"SELECT issue, record_id, (SELECT count(*) FROM ({AUDIT})) > 100 AS truncated FROM ({AUDIT}) ORDER BY issue, record_id LIMIT 100",
    "career_values": f"""
WITH {M}, {S}, v AS (SELECT DISTINCT season_id, player_id, off_value, mid_value, def_value, total_value FROM ({value_sql(False)})), g AS (SELECT season_id, code, year, player_id, count(*) AS games, CAST(sum(disposals) AS BIGINT) AS total_disposals, CAST(sum(goals) AS BIGINT) AS total_goals FROM s JOIN m ON m.id = s.match_id GROUP BY 1, 2, 3, 4)
SELECT code, year, g.player_id, first_name, surname, games, total_disposals, total_goals, total_value FROM g LEFT JOIN v USING (season_id, player_id) LEFT JOIN players p ON p.id = g.player_id""",
    "integrity_counts": f"""
WITH {S}, q AS (SELECT home_goals AS a, home_q1_goals + home_q2_goals + home_q3_goals + home_q4_goals AS b, away_goals AS c, away_q1_goals + away_q2_goals + away_q3_goals + away_q4_goals AS d, home_behinds AS e, home_q1_behinds + home_q2_behinds + home_q3_behinds + home_q4_behinds AS f, away_behinds AS g, away_q1_behinds + away_q2_behinds + away_q3_behinds + away_q4_behinds AS h FROM matches)
SELECT 'margin' AS invariant, count(margin - home_points + away_points) AS checked, count(*) FILTER (WHERE margin <> home_points - away_points) AS broken FROM matches
UNION ALL SELECT 'match_points', count(home_points + home_goals + home_behinds + away_points + away_goals + away_behinds), count(*) FILTER (WHERE home_points <> home_goals * 6 + home_behinds OR away_points <> away_goals * 6 + away_behinds) FROM matches
UNION ALL SELECT 'quarter_scores', count(a + b + c + d + e + f + g + h), count(*) FILTER (WHERE a <> b OR c <> d OR e <> f OR g <> h) FROM q
UNION ALL SELECT 'disposals', count(disposals + kicks + handballs), count(*) FILTER (WHERE disposals <> kicks + handballs) FROM s
UNION ALL SELECT 'clearances', count(clearances + centre_clearances + stoppage_clearances), count(*) FILTER (WHERE clearances <> centre_clearances + stoppage_clearances) FROM s""",
    "value_gaps": f"""
WITH {M}, {S}, l AS (SELECT match_id, team_id, count(*) FILTER (WHERE {" OR ".join(f"{c} IS NULL" for c in INPUTS)}) AS broken FROM s GROUP BY 1, 2),
p AS (SELECT id AS match_id, season_id, home_points IS NULL OR away_points IS NULL AS unscored, unnest([home_team_id, away_team_id]) AS team_id FROM m WHERE status = 'Complete')
SELECT season_id, count(*) FILTER (WHERE unscored) AS unscored_sides, count(*) FILTER (WHERE broken IS NULL) AS sides_without_lines, CAST(sum(coalesce(broken, 0)) AS BIGINT) AS lines_without_input,
  count(*) FILTER (WHERE unscored OR broken IS NULL OR broken > 0) = 0 AS complete FROM p LEFT JOIN l USING (match_id, team_id) GROUP BY 1""",
    "weather_sanity": """
SELECT source, count(*) AS n_rows, count(*) FILTER (WHERE temp_c IS NULL) AS no_temp, count(*) FILTER (WHERE temp_c NOT BETWEEN -20 AND 55) AS bad_temp, count(*) FILTER (WHERE humidity_pct NOT BETWEEN 0 AND 100) AS bad_humidity,
  count(*) FILTER (WHERE precip_mm < 0) AS bad_rain, count(*) FILTER (WHERE wind_gust_kmh < wind_speed_kmh) AS gust_below_wind FROM match_weather GROUP BY 1""",
    "birth_coverage": f"""
WITH {M}, x AS (SELECT code, player_id, max(year) AS y FROM player_match_stats s JOIN m ON m.id = s.match_id GROUP BY 1, 2), a AS (SELECT code, y, CAST(substr(date_of_birth, 1, 4) AS INT) AS b FROM x JOIN players p ON p.id = x.player_id)
SELECT code, count(*) AS n_players, count(b) AS with_birth, count(*) FILTER (WHERE y - b NOT BETWEEN 15 AND 45) AS odd_ages, min(y - b) AS youngest, max(y - b) AS oldest FROM a GROUP BY 1""",
    "coverage": f"""
WITH {M}, {S}, x AS (SELECT code, year, count(*) AS n_rows, count(COLUMNS(s.* EXCLUDE (id, match_id, player_id, team_id, load_no, rn))) FROM s JOIN m ON m.id = s.match_id GROUP BY code, year)
SELECT code, year, column_name, n_rows, known, round(CAST(known AS DOUBLE) / n_rows, 6) AS ratio FROM (UNPIVOT x ON COLUMNS(* EXCLUDE (code, year, n_rows)) INTO NAME column_name VALUE known)""",
    "team_values": f"""
SELECT season_id, player_id, first_name, surname, t.name AS team, total_value FROM ({value_sql(False)}) v JOIN players p ON p.id = v.player_id JOIN teams t ON t.id = v.team_id""",
    "match_coaches": f"""
WITH {M}, o AS (SELECT match_id, team_id, min(display_name) AS coach FROM coach_observations WHERE provider = 'afl-tables' GROUP BY 1, 2)
SELECT m.id AS match_id, h.name AS home_team, a.name AS away_team, hc.coach AS home_coach, ac.coach AS away_coach FROM m JOIN teams h ON h.id = home_team_id JOIN teams a ON a.id = away_team_id
LEFT JOIN o hc ON hc.match_id = m.id AND hc.team_id = home_team_id LEFT JOIN o ac ON ac.match_id = m.id AND ac.team_id = away_team_id WHERE m.competition_id = 1""",
    "swapped_sides": "SELECT id, -margin AS margin, " + ", ".join(f"{o}_{c} AS {s}_{c}" for s, o in (("home", "away"), ("away", "home")) for c in ("team_id", "goals", "behinds", "points", "rushed_behinds", "minutes_in_front", *(f"q{q}_{k}" for q in range(1, 5) for k in ("goals", "behinds")))) + " FROM matches",
}
