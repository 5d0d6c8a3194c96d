"""Operators that keep derived and dependent tables in step with what was delivered.

Each gives a new table from old ones by joins on keys; nothing is updated in place. Defined results:
null keys equal nothing, so that a row with one is inserted, kept, or reported as unknown; repeated
rows of a delivery count once; an empty side is fine.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identify(new: DataFrame, old: DataFrame, external: str, natural: list[str], key: str = "id") -> DataFrame:
    """``new`` with ``found`` (the old row's key) and ``stage``: by the external id, else by the natural
    key among old rows that no external id has claimed, else ``new``. An id or natural key that
    several old rows share finds the smallest."""
    by_id = old.where(F.col(external).isNotNull()).groupBy(external).agg(F.min(key).alias("_by_id"))
    first = new.join(by_id, external, "left")
    claimed = first.where("_by_id is not null").select(F.col("_by_id").alias(key)).distinct()
    by_natural = old.join(claimed, key, "left_anti").dropna(subset=natural).groupBy(*natural).agg(F.min(key).alias("_by_natural"))
    both = first.join(by_natural, natural, "left")
    stage = F.when(F.col("_by_id").isNotNull(), "external").when(F.col("_by_natural").isNotNull(), "natural").otherwise("new")
    return both.select(*new.columns, F.coalesce("_by_id", "_by_natural").alias("found"), stage.alias("stage"))


def admitted(lines: DataFrame, existing: DataFrame, known: dict[str, DataFrame], keys: list[str], idle: Column) -> DataFrame:
    """``lines`` whose columns of ``known`` are all in their one-column tables, without those that are
    ``idle`` unless ``existing`` holds their keys already."""
    out = lines
    for column, parents in known.items():
        out = out.join(parents.toDF(column).distinct(), column, "left_semi")
    there = existing.select(*keys).distinct()
    return out.where(~F.coalesce(idle, F.lit(False))).unionByName(out.where(idle).join(there, keys, "left_semi"))


def snapshot_faults(rows: DataFrame, group: list[str], member: str, known: DataFrame, sizes: tuple[int, int], counted: Column) -> DataFrame:
    """(group, listed, twice, unknown, valid) of each group of a snapshot: members counted, members that
    occur more than once, members not in ``known``, and whether it may replace what is there."""
    k = known.toDF(member).distinct().withColumn("_known", F.lit(True))
    per = rows.groupBy(*group, member).agg(F.count("*").alias("_n"), F.max(counted.cast("int")).alias("_counted")).join(k, member, "left")
    out = per.groupBy(*group).agg(F.sum("_counted").alias("listed"), F.count_if(F.col("_n") > 1).alias("twice"), F.count_if(F.col("_known").isNull()).alias("unknown"))
    return out.withColumn("valid", F.col("listed").between(*sizes) & (F.col("twice") == 0) & (F.col("unknown") == 0))


def corrected(old: DataFrame, corrections: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``old`` with ``column`` set to ``corrections.corrected`` where it still is ``corrections.expected``."""
    c = corrections.select(*keys, F.col("expected").alias("_expected"), F.col("corrected").alias("_corrected"), F.lit(True).alias("_is_listed"))
    return old.join(c, keys, "left").withColumn(column, F.when(F.col("_is_listed") & F.col(column).eqNullSafe(F.col("_expected")), F.col("_corrected")).otherwise(F.col(column))).select(*old.columns)


def assigned(old: DataFrame, values: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``old`` with several columns taken from the row of ``values`` with its keys at once, nulls too;
    rows without one stay as they are."""
    v = values.select(*keys, F.struct(*columns).alias("_v"))
    return old.join(v, keys, "left").withColumns({c: F.when(F.col("_v").isNotNull(), F.col(f"_v.{c}")).otherwise(F.col(c)) for c in columns}).select(*old.columns)


def rekeyed(df: DataFrame, columns: list[str], old: int, new: int, where: Column | None = None) -> DataFrame:
    """``df`` with ``new`` for ``old`` in ``columns``, in the rows that ``where`` admits."""
    holds = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(holds & (F.col(c) == old), F.lit(new)).otherwise(F.col(c)) for c in columns})


def revised(old: DataFrame, merged: DataFrame, key: str, revision: str = "revision") -> DataFrame:
    """(key, revision) of a merged table: one more than before in rows that the merge changed, 1 in new ones."""
    before = old.select(key, F.col(revision).alias("_before"))
    step = F.when(F.col("_change") == "updated", 1).otherwise(0)
    return merged.join(before, key, "left").select(key, F.when(F.col("_change") == "inserted", 1).otherwise(F.coalesce("_before", F.lit(0)) + step).alias(revision))


def invalidated(children: DataFrame, old: DataFrame, new: DataFrame, key: str, watched: list[str], reference: str) -> DataFrame:
    """``children`` without those whose ``reference`` is the key of a row of which a watched column changed."""
    was, now = old.select(key, *[F.col(c).alias(f"_was_{c}") for c in watched]), new.select(key, *watched)
    changed = was.join(now, key)
    differs = F.lit(False)
    for c in watched:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_was_{c}"))
    return children.join(changed.where(differs).select(F.col(key).alias(reference)).distinct(), reference, "left_anti")


def pruned(old: DataFrame, snapshot: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """``old`` without the rows that a complete snapshot of their group does not name; groups of which
    there is no snapshot stay whole."""
    whole = old.join(snapshot.select(*group).distinct(), group, "left_anti")
    return whole.unionByName(old.join(snapshot.select(*group, *keys).distinct(), [*group, *keys], "left_semi").select(*whole.columns))


def retained(df: DataFrame, column: str, now: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before ``now``; rows without a time stay."""
    return df.where(F.col(column).isNull() | (F.col(column) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL '{days}' DAY")))


def cascaded(deleted: DataFrame, children: dict[str, tuple[DataFrame, str]], key: str = "id") -> dict[str, DataFrame]:
    """Each child table without the rows that refer to a deleted parent. children: name to (table, column)."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    return {name: t.join(gone, F.col(c) == F.col("_gone"), "left_anti") for name, (t, c) in children.items()}


def reconciled(observations: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, status) of coach observations that state a match: unknown-match, invalid-participant (a team
    that did not take part), score-mismatch (either order of the points differs), duplicate (another
    coach of one provider, match and team), else assigned: the first that holds."""
    m = matches.select(F.col("id").alias("_match"), "home_team_id", "away_team_id", F.col("home_points").alias("_home"), F.col("away_points").alias("_away")).dropDuplicates(["_match"])
    o = observations.where("match_id is not null").select("id", "provider", "match_id", "team_id", "home_points", "away_points", "external_coach_id").distinct()
    coaches = o.groupBy("provider", "match_id", "team_id").agg(F.count_distinct(F.coalesce("external_coach_id", F.lit(""))).alias("_coaches"))
    j = o.join(m, F.col("match_id") == F.col("_match"), "left").join(coaches.withColumnsRenamed({c: f"_c_{c}" for c in ("provider", "match_id", "team_id")}), F.col("provider").eqNullSafe(F.col("_c_provider")) & (F.col("match_id") == F.col("_c_match_id")) & F.col("team_id").eqNullSafe(F.col("_c_team_id")), "left")
    same = ((F.col("home_points") == F.col("_home")) & (F.col("away_points") == F.col("_away"))) | ((F.col("home_points") == F.col("_away")) & (F.col("away_points") == F.col("_home")))
    outside = ~((F.col("team_id") == F.col("home_team_id")) | (F.col("team_id") == F.col("away_team_id")))
    status = (
        F.when(F.col("_match").isNull(), "unknown-match").when(F.coalesce(outside, F.lit(False)), "invalid-participant")
        .when(F.coalesce(~same, F.lit(False)), "score-mismatch").when(F.col("_coaches") > 1, "duplicate").otherwise("assigned")
    )
    return j.select("id", status.alias("status"))


def digest(rows: list[dict]) -> str:
    """SHA-256 of a preview's rows as JSON, whatever their order."""
    return hashlib.sha256(json.dumps(sorted(json.dumps(r, sort_keys=True, default=str) for r in rows)).encode()).hexdigest()


def approved(preview: DataFrame, wanted: str) -> DataFrame:
    """``preview``, a short list of what an operation would do, if its digest is the one approved."""
    got = digest([r.asDict(recursive=True) for r in preview.collect()])
    if got != wanted:
        raise ValueError(f"the preview has the digest {got}, not the approved one")
    return preview
