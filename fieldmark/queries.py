"""The core's queries over one snapshot directory, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.operators import instants, profile, spikes
from fieldmark.plans import operations, relational, surface, upkeep, warehouse_sql
from fieldmark.plans import warehouse as wh
from fieldmark.sources import read_table


def _starts(spark: SparkSession, d: str) -> DataFrame:
    return instants.match_starts(read_table(spark, d, "matches"), read_table(spark, d, "venues"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.p1_found(_starts(spark, d))


def p1_statuses(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each basis and pair of statuses has."""
    return _starts(spark, d).groupBy("basis", "kickoff_status", "wall_status").agg(F.count("*").alias("n"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.p3_found(spark, profile.warehouse_sources(d))


def p3_columns(spark: SparkSession, d: str) -> DataFrame:
    """The profile of every column of both tables."""
    a, b = (profile.column_profile(spark, s) for s in profile.warehouse_sources(d))
    return a.unionByName(b)


def p3_loads(spark: SparkSession, d: str) -> DataFrame:
    """The profile of every column and load of both tables, and whether it departs from that of most loads."""
    a, b = (profile.load_comparison(spark, s) for s in profile.warehouse_sources(d))
    return a.unionByName(b).withColumn("mean", F.round("mean", 3))


def _faults(spark: SparkSession, d: str) -> DataFrame:
    matches, venues = read_table(spark, d, "matches"), read_table(spark, d, "venues")
    return spikes.flag(spikes.weather_readings(read_table(spark, d, "match_weather"), matches, venues, _starts(spark, d)))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.p7_found(_faults(spark, d))


def p7_faults(spark: SparkSession, d: str) -> DataFrame:
    """How many readings of each source and field have each fault."""
    return _faults(spark, d).groupBy("source", "field", "fault").agg(F.count("*").alias("n"))


def _on_warehouse(f: Callable[..., DataFrame], *args) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(wh.Warehouse(spark, d), *args)


PROBLEMS = {f.__name__: f for f in (p1_found, p1_statuses, p3_found, p3_columns, p3_loads, p7_found, p7_faults)}
WAREHOUSE = {f.__name__: _on_warehouse(f) for f in (wh.ladder, wh.match_names, wh.grand_finals, wh.career_arc, wh.career_values, wh.source_comparisons, wh.lineup_changes, wh.wet_games, wh.tipping, wh.season_value, wh.team_values, wh.match_coaches, wh.swapped_sides, wh.coverage, wh.match_inventory, wh.audit, wh.audit_page, wh.integrity_counts, wh.value_gaps, wh.weather_sanity, wh.birth_coverage)}
WAREHOUSE |= {f"integrity_{k}": _on_warehouse(wh.integrity, k) for k in ("margin", "match_points", "quarter_scores", "disposals", "clearances", "votes")}
WAREHOUSE["season_value_known"] = _on_warehouse(wh.season_value, False)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = PROBLEMS | WAREHOUSE | relational.QUERIES | surface.QUERIES | operations.QUERIES | upkeep.QUERIES
SQL: dict[str, str] = warehouse_sql.SQL | relational.SQL | surface.SQL | operations.SQL | upkeep.SQL
