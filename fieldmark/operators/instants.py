"""Mixed timestamp texts to one unambiguous form: microseconds since 1970 UTC.

Method: every text's character-class mask selects a parser that is compiled once per mask
(:mod:`fieldmark.functions.timetext`); wall times go through versioned zone transition tables
(:mod:`fieldmark.functions.zones`). All of it is one Arrow-batched projection: no shuffle, no
broadcast, and each row depends on itself only.

Defined results, in the ``status`` of each row: ``ok``; ``missing`` (null or empty text);
``unreadable`` (no known shape, or impossible field values); ``no_date`` or
``no_time`` (a part is missing); ``no_zone`` (wall time without any known zone); ``twice`` and
``never`` (the wall time occurs twice or never in its zone). ``epoch_us`` is null unless ``ok``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.timetext import read
from fieldmark.functions.zones import tz_version, wall_to_epoch, zone_name

RESULT = "epoch_us long, status string"


def _resolve(parts: pd.DataFrame, zones: pd.Series, missing: np.ndarray, version: str) -> pd.DataFrame:
    n = len(parts)
    day, sod, offset = (parts[c].to_numpy(dtype=float) for c in ("day", "sod_us", "offset_s"))
    epoch = parts["epoch_us"]
    status = np.full(n, "ok", dtype=object)
    value = epoch.fillna(0).to_numpy(dtype=np.int64).copy()
    fixed = epoch.notna().to_numpy()
    no_day, no_time = np.isnan(day) & ~fixed, np.isnan(sod) & ~fixed
    wall = ~fixed & ~no_day & ~no_time
    # a wall time is whole seconds and a rest, so that nothing passes through a float
    wall_s = np.where(wall, np.nan_to_num(day) * 86400 + np.nan_to_num(sod) // 1_000_000, 0).astype(np.int64)
    rest = np.where(wall, np.nan_to_num(sod) % 1_000_000, 0).astype(np.int64)
    with_offset = wall & ~np.isnan(offset)
    value[with_offset] = (wall_s[with_offset] - offset[with_offset].astype(np.int64)) * 1_000_000 + rest[with_offset]
    # each distinct zone is looked up once; a zone in the text holds before the one given
    code, distinct = pd.factorize(parts["region"].where(parts["region"].notna(), zones.where(zones.notna(), None).reset_index(drop=True)))
    known = np.array([*(zone_name(z) for z in distinct), None], dtype=object)
    names = known[code]
    open_ = wall & ~with_offset
    unknown = open_ & np.array([x is None for x in known], dtype=bool)[code]
    for name in pd.unique(names[open_ & ~unknown]):
        at = np.flatnonzero(open_ & (names == name))
        seconds, count = wall_to_epoch(wall_s[at], name, version)
        value[at] = seconds * 1_000_000 + rest[at]
        status[at[count == 2]] = "twice"
        status[at[count == 0]] = "never"
    status[unknown] = "no_zone"
    status[no_time] = "no_time"
    status[no_day] = "no_date"
    status[no_day & no_time] = "unreadable"
    status[missing] = "missing"
    return pd.DataFrame({"epoch_us": pd.Series(value, dtype="Int64").where(pd.Series(status == "ok")), "status": status})


def _missing(texts: pd.Series) -> np.ndarray:
    return (texts.isna() | (texts.fillna("").str.strip() == "")).to_numpy()


def instant(text: Column, zone: Column, version: str | None = None) -> Column:
    """Struct<epoch_us, status> of a text that holds date and time; ``zone`` is the IANA name that
    holds where the text names neither zone nor offset."""
    version = version or tz_version()

    @F.pandas_udf(RESULT)
    def parse(texts: pd.Series, zones: pd.Series) -> pd.DataFrame:
        return _resolve(read(texts), zones, _missing(texts), version)

    return parse(text.cast("string"), zone.cast("string"))


def instant_of_parts(date: Column, time: Column, zone: Column, version: str | None = None) -> Column:
    """As :func:`instant`, of a date text and a time text. A zone or offset in the time text holds,
    else one in the date text, else ``zone``; a time of day in the date text is ignored."""
    version = version or tz_version()

    @F.pandas_udf(RESULT)
    def parse(dates: pd.Series, times: pd.Series, zones: pd.Series) -> pd.DataFrame:
        d, t = read(dates), read(times)
        t["day"] = d["day"]
        bare = t["offset_s"].isna() & t["region"].isna()
        t["offset_s"] = t["offset_s"].where(~bare, d["offset_s"])
        t["region"] = t["region"].where(~bare, d["region"])
        t["epoch_us"] = pd.Series([pd.NA] * len(t), dtype="Int64")
        return _resolve(t, zones, _missing(dates) | _missing(times), version)

    return parse(date.cast("string"), time.cast("string"), zone.cast("string"))


def date_of(text: Column) -> Column:
    """The calendar date that a text states, whatever its form; null if it states none."""

    @F.pandas_udf("int")
    def parse(texts: pd.Series) -> pd.Series:
        return read(texts)["day"].astype("Int64").astype("Int32")

    return F.date_add(F.to_date(F.lit("1970-01-01")), parse(text.cast("string")))


def match_starts(matches: DataFrame, venues: DataFrame, home_zone: str = "Australia/Melbourne") -> DataFrame:
    """(match_id, epoch_us, basis, kickoff_status, wall_status) for every row of ``matches``.

    ``basis`` says what fixed the instant: ``kickoff``, else ``date_time``, else null. Matches of an
    unknown venue, and venues without zone of which the canonical venue has none either, have no
    zone for a bare kickoff text. Repeated rows give repeated results; extra columns are ignored.
    """
    v = venues.select(F.col("id").alias("v_id"), F.coalesce("canonical_venue_id", "id").alias("c_id"), F.nullif(F.trim("timezone"), F.lit("")).alias("own_zone"))
    canonical = v.select(F.col("v_id").alias("c_id"), F.col("own_zone").alias("canonical_zone"))
    zones = v.join(canonical, "c_id", "left").select("v_id", F.coalesce("own_zone", "canonical_zone").alias("venue_zone"))
    found = (
        matches.select(F.col("id").alias("match_id"), "venue_id", "date", "local_time", "kickoff_at")
        .join(zones, F.col("venue_id") == F.col("v_id"), "left")
        .select("match_id", instant(F.col("kickoff_at"), F.col("venue_zone")).alias("k"), instant_of_parts(F.col("date"), F.col("local_time"), F.lit(home_zone)).alias("w"))
    )
    return found.select(
        "match_id",
        F.coalesce("k.epoch_us", "w.epoch_us").alias("epoch_us"),
        F.when(F.col("k.epoch_us").isNotNull(), "kickoff").when(F.col("w.epoch_us").isNotNull(), "date_time").alias("basis"),
        F.col("k.status").alias("kickoff_status"),
        F.col("w.status").alias("wall_status"),
    )


def p1_found(starts: DataFrame) -> DataFrame:
    """(match_id, kickoff_epoch_s) of the matches whose row fixes their start."""
    return starts.where("epoch_us is not null").select("match_id", F.floor(F.col("epoch_us") / F.lit(1_000_000)).cast("long").alias("kickoff_epoch_s")).distinct()
