"""Relational operators one by one: scans, predicates, joins, aggregates, windows, sets, scalars.

Each entry is a query over the snapshot's tables, named in braces; where DuckDB words it differently,
the second text is its form. The texts are the engine's public SQL surface: what a caller may type.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fieldmark.sources import read_table

TEXTS: dict[str, str | tuple[str, str]] = {
    # projection and predicates
    "project_arithmetic": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, l_linenumber * 2 - 1 AS odd, l_quantity + 0.5 AS q FROM {lineitem}",
    "filter_between_in": "SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_totalprice BETWEEN 1000 AND 100000 AND o_orderstatus IN ('F', 'P') AND o_orderpriority NOT IN ('1-URGENT')",
    "filter_null_safe": ("SELECT id FROM {matches} WHERE NOT (status <=> 'Complete')", "SELECT id FROM matches WHERE status IS DISTINCT FROM 'Complete'"),
    "filter_like_case": "SELECT p_partkey, p_name FROM {part} WHERE p_name ILIKE '%A%' AND p_name NOT LIKE 'Z%'",
    "filter_optional": "SELECT c_custkey FROM {customer} WHERE (NULL IS NULL OR c_mktsegment = 'x') AND c_acctbal > 0",
    "row_values": "SELECT n_nationkey FROM {nation} WHERE (n_regionkey, n_nationkey) IN ((0, 0), (1, 1), (2, 7))",
    "case_ladder": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band FROM {orders}",
    "safe_divide": "SELECT id, round(CAST(home_points AS DOUBLE) / nullif(away_behinds, 0), 4) AS ratio FROM {matches}",
    "string_dates": "SELECT id FROM {matches} WHERE substr(date, 1, 10) >= '2018-01-01' AND substr(date, 1, 10) < '2027-01-01'",
    # joins
    "join_star": "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name, n_name",
    "join_two_roles": "SELECT m.id, h.name AS home, a.name AS away FROM {matches} m JOIN {teams} h ON h.id = m.home_team_id JOIN {teams} a ON a.id = m.away_team_id",
    "join_left_condition": "SELECT m.id, w.temp_c FROM {matches} m LEFT JOIN (SELECT match_id, max(temp_c) AS temp_c FROM {match_weather} WHERE kind = 'observed' GROUP BY match_id) w ON w.match_id = m.id AND m.status = 'Complete'",
    "join_left_composite": "SELECT m.id, count(l.id) AS listed FROM {matches} m LEFT JOIN {match_lineups} l ON l.match_id = m.id AND l.team_id = m.home_team_id GROUP BY m.id",
    "join_semi": "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)",
    "join_in_subquery": "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING')",
    "join_anti": "SELECT o_orderkey FROM {orders} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey)",
    "join_self": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_full_using": "SELECT k, s.s_name, c.c_name FROM (SELECT s_suppkey AS k, s_name FROM {supplier}) s FULL OUTER JOIN (SELECT c_custkey AS k, c_name FROM {customer} WHERE c_acctbal > 0) c USING (k)",
    "join_canonical": "SELECT v.id, c.name FROM {venues} v JOIN {venues} c ON c.id = coalesce(v.canonical_venue_id, v.id)",
    "join_latest_row": "SELECT player_id, match_id, id FROM (SELECT player_id, match_id, id, row_number() OVER (PARTITION BY player_id ORDER BY match_id DESC, id DESC) AS k FROM {player_match_stats}) WHERE k = 1",
    "join_argmax": ("SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS best FROM {orders} GROUP BY o_custkey", "SELECT o_custkey, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS best FROM orders GROUP BY o_custkey"),
    "join_one_row": "SELECT o_orderstatus, round(sum(o_totalprice) / max(t.whole), 6) AS share FROM {orders} JOIN (SELECT sum(o_totalprice) AS whole, 1 AS one FROM {orders}) t ON t.one = 1 GROUP BY o_orderstatus",
    # the team of either side of a match: one scan unpivots both sides, so the join stays an equality
    "join_either_side": (
        "SELECT t.id AS team_id, count(*) AS matches FROM (SELECT explode(array(home_team_id, away_team_id)) AS team_id FROM {matches}) s JOIN {teams} t ON t.id = s.team_id GROUP BY t.id",
        "SELECT t.id AS team_id, count(*) AS matches FROM teams t JOIN matches m ON t.id = m.home_team_id OR t.id = m.away_team_id GROUP BY t.id",
    ),
    "join_unrecovered": "SELECT e.event_id FROM {events} e WHERE e.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM {events} r WHERE r.user_id = e.user_id AND r.event_type = 'purchase' AND r.event_id > e.event_id)",
    # aggregates
    "agg_basic": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_tax) AS lo, max(l_tax) AS hi FROM {lineitem} GROUP BY l_returnflag, l_linestatus",
    "agg_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT CASE WHEN l_quantity > 25 THEN l_partkey END) AS parts FROM {lineitem} GROUP BY l_returnflag",
    "agg_distinct_pairs": ("SELECT count(DISTINCT match_id, team_id) AS n FROM {player_match_stats}", "SELECT count(DISTINCT (match_id, team_id)) AS n FROM player_match_stats"),
    "agg_conditional": ("SELECT status, count_if(margin > 0) AS home, sum(CASE WHEN margin = 0 THEN 1 ELSE 0 END) AS level, max(CASE WHEN margin < 0 THEN id END) AS last_loss FROM {matches} GROUP BY status", "SELECT status, count(*) FILTER (WHERE margin > 0) AS home, CAST(sum(CASE WHEN margin = 0 THEN 1 ELSE 0 END) AS BIGINT) AS level, max(CASE WHEN margin < 0 THEN id END) AS last_loss FROM matches GROUP BY status"),
    "agg_filter": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS n, round(avg(value) FILTER (WHERE user_id % 2 = 0), 4) AS mean_even FROM {events} GROUP BY event_type",
    "agg_global_empty": "SELECT count(*) AS n, max(o_orderkey) AS top FROM {orders} WHERE o_orderkey < 0",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 15",
    "agg_two_levels": "SELECT team_id, round(avg(i50), 4) AS mean_i50, max(i50) AS most FROM (SELECT match_id, team_id, sum(inside_fifties) AS i50 FROM {player_match_stats} WHERE inside_fifties BETWEEN 0 AND 25 GROUP BY match_id, team_id) GROUP BY team_id",
    "agg_mean_error": "SELECT code, round(avg(abs(margin)), 4) AS mae FROM (SELECT margin, round_type AS code FROM {matches}) GROUP BY code",
    "agg_census": "SELECT count(*) AS n, count(attendance) AS attendance, count(venue_id) AS venue_id, count(kickoff_at) AS kickoff_at, count(local_time) AS local_time FROM {matches}",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_list": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey"),
    "agg_total": ("SELECT o_orderstatus, coalesce(round(sum(CASE WHEN o_totalprice > 1e9 THEN o_totalprice END), 2), 0D) AS t FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, coalesce(round(sum(CASE WHEN o_totalprice > 1e9 THEN o_totalprice END), 2), 0) AS t FROM orders GROUP BY o_orderstatus"),
    "scalar_greatest": ("SELECT id, CASE WHEN margin IS NULL THEN NULL ELSE greatest(0, margin) END AS lead FROM {matches}", "SELECT id, CASE WHEN margin IS NULL THEN NULL ELSE greatest(0, margin) END AS lead FROM matches"),
    # windows
    "window_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM {orders}",
    "window_lag_lead": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS later FROM {orders}",
    "window_frame": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s3, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {events}",
    "window_ntile": "SELECT s_suppkey, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS quarter FROM {supplier}",
    "window_stratified": ("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY sha2(CAST(doc_id AS STRING), 256)) AS k FROM (SELECT DISTINCT doc_id, source FROM {documents})) WHERE k <= 5", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS k FROM (SELECT DISTINCT doc_id, source FROM documents)) WHERE k <= 5"),
    # order, limit, sets, subqueries
    "top_k": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "top_k_offset": "SELECT o_orderkey FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 15",
    "order_aggregate": "SELECT o_custkey FROM {orders} GROUP BY o_custkey ORDER BY max(o_orderdate) ASC NULLS FIRST, o_custkey LIMIT 7",
    "set_union_all": "SELECT 'customer' AS kind, c_nationkey AS k FROM {customer} UNION ALL SELECT 'supplier', s_nationkey FROM {supplier}",
    "set_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "set_intersect": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}",
    "set_except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 250000",
    "scalar_subquery": "SELECT n_name, (SELECT count(*) FROM {customer} WHERE c_nationkey = n_nationkey) AS customers FROM {nation}",
    "exists_in_count": "SELECT m.status, count(CASE WHEN l.match_id IS NOT NULL THEN 1 END) AS listed, count(*) AS n FROM {matches} m LEFT JOIN (SELECT DISTINCT match_id FROM {match_lineups}) l ON l.match_id = m.id GROUP BY m.status",
    "recursive": ("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, n * n AS sq FROM t", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, n * n AS sq FROM t"),
    "inline_values": "WITH fix(k, name) AS (VALUES (0, 'zero'), (1, 'one'), (9, 'nine')) SELECT n_nationkey, name FROM {nation} JOIN fix ON k = n_nationkey",
    # JSON, text, time
    "json_rows": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "json_each": ("SELECT col AS id FROM (SELECT explode(from_json('[3, 5, 8]', 'array<bigint>')))", "SELECT unnest(CAST('[3, 5, 8]' AS JSON)::BIGINT[]) AS id"),
    "text_functions": "SELECT doc_id, upper(substr(source, 1, 3)) AS s, length(lang) AS n, coalesce(lang, '?') || '/' || coalesce(source, '?') AS both_ FROM {documents}",
    "hash_sha256": ("SELECT doc_id, sha2(text, 256) AS h FROM {documents}", "SELECT doc_id, sha256(text) AS h FROM documents"),
    "date_add_text": ("SELECT o_orderkey, date_format(date_add(o_orderdate, -3), 'yyyy-MM-dd') AS d FROM {orders}", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) - 3, '%Y-%m-%d') AS d FROM orders"),
    "julian_day": ("SELECT event_id, round(unix_timestamp(ts) / 86400D + 2440587.5D, 3) AS jd FROM {events}", "SELECT event_id, round(floor(epoch(ts)) / 86400 + 2440587.5, 3) AS jd FROM events"),
    "melbourne_time": ("SELECT doc_id, date_format(from_utc_timestamp(published_at, 'Australia/Melbourne'), 'yyyy-MM-dd HH:mm:ss') AS local FROM {documents}", "SELECT doc_id, strftime(timezone('Australia/Melbourne', timezone('UTC', published_at)), '%Y-%m-%d %H:%M:%S') AS local FROM documents"),
    "name_form": ("SELECT id, regexp_replace(lower(coalesce(surname, '')), '[^a-z0-9]', '') AS plain FROM {players}", "SELECT id, regexp_replace(lower(coalesce(surname, '')), '[^a-z0-9]', '', 'g') AS plain FROM players"),
    "retry_hours": "SELECT o_orderkey, CAST(least(power(2, least(greatest(o_orderkey % 9, 1) - 1, 5)), 24) AS INT) AS hours FROM {orders}",
    "js_round": "SELECT match_id, kind, floor(temp_c * 10 + 0.5) / 10 AS t FROM {match_weather}",
}


def query(name: str):
    """The query ``name`` as a function of (spark, directory)."""
    text = TEXTS[name] if isinstance(TEXTS[name], str) else TEXTS[name][0]

    def run(spark: SparkSession, directory: str) -> DataFrame:
        tables = {t: read_table(spark, directory, t) for t in set(re.findall(r"\{(\w+)\}", text))}
        return spark.sql(text, **tables)

    run.__name__ = name
    return run


QUERIES = {name: query(name) for name in TEXTS}
SQL = {name: re.sub(r"\{(\w+)\}", r"\1", t if isinstance(t, str) else t[1]) for name, t in TEXTS.items()}
