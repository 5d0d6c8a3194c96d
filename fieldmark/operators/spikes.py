"""Implausible readings: bounds, phase-space spikes and stuck values, relative to each source.

Method: readings are reduced to departures from what their source gives for the place, month and
hour (medians, swept out in turn). The departures of a source and place, in order of fetching, are
points in the space of value, first and second difference. A point outside a robust ellipsoid of two
of them is a spike; spikes are replaced by the expected value and the spreads estimated again, until
none is left. Runs of one value and values beyond physical bounds are found beside it.

Departures from plain phase-space thresholding: a spike throws its neighbours' differences out too,
so of a point and its two neighbours on each side only the one that departs most is a spike by its
differences. The ellipse of value and second difference is that of the value and of what the value
leaves of the second difference, as the two go together in any series of independent readings.

Plan: medians by partial aggregation; each series is cut into blocks of ``BLOCK`` rows with
``HALO`` rows of its neighbours (:mod:`fieldmark.plans.blocks`), so that a source that holds a third
of all readings is worked on by many tasks. A pass is two aggregations to a row a source and field,
and one window over the blocks.

Defined results: null readings are never flagged and break a run; exact copies of a row count once;
rows with a null source form one source; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.plans.blocks import in_blocks
from fieldmark.plans.lineage import cut

#: What the readings can be at all. Everything within is judged against its source.
BOUNDS = {"temp_c": (-90.0, 57.0), "wind_gust_kmh": (0.0, 410.0), "precip_mm": (0.0, 900.0), "humidity_pct": (0.0, 100.0)}
FIELDS = tuple(BOUNDS)
#: Readings that must repeat for a stuck sensor.
RUN = 5
#: Rows of a block, and passes before blocks get their neighbours' rows anew.
BLOCK, PASSES = 20_000, 5
#: Each pass reads two neighbours' replaced values on each side.
HALO = max(RUN, 2 * PASSES + 2)
#: Times the universal threshold sqrt(2 ln n): departures of weather have longer tails than the normal law it is made for.
WIDTH = 1.2
#: Least number of readings of a group that counts in full.
SHRINK = 10


def _scaled(field: str) -> Column:
    """The reading on a scale on which its departures are about symmetric; null where out of bounds,
    and for no rain, which is no amount."""
    low, high = BOUNDS[field]
    x = F.col(field)
    good = x.between(low, high)
    if field == "wind_gust_kmh":
        return F.when(good, F.log1p(x))
    if field == "precip_mm":
        return F.when(good & (x > 0), F.cbrt(x))
    return F.when(good, x)


def departures(readings: DataFrame) -> DataFrame:
    """``readings`` with ``_u_<field>``. Needs the columns source, place, band, month and hour."""
    df = readings.select("*", *[_scaled(f).alias(f"_u_{f}") for f in FIELDS])
    df = df.withColumns({"_source": F.coalesce("source", F.lit("")), "_place": F.coalesce("place", F.lit(-1)), "_season": F.coalesce(F.col("band") * 100 + F.col("month"), F.lit(-99999)), "_hour": F.coalesce(F.floor(F.col("hour") / 2), F.lit(-1))})
    for k, keys in enumerate(([], ["_season"], ["_place"], ["_hour"], ["_season"], ["_place"])):
        if k % 2 == 0:
            # each sweep reads its input twice; without a cut the plan would double with every sweep
            df = cut(df)
        by = ["_source", *keys]
        effect = df.groupBy(*by).agg(*[F.struct(F.percentile_approx(f"_u_{f}", 0.5, 1000).alias("m"), F.count(f"_u_{f}").alias("n")).alias(f"_e_{f}") for f in FIELDS])
        shrunk = [(F.col(f"_e_{f}.m") * (F.col(f"_e_{f}.n") / (F.col(f"_e_{f}.n") + (SHRINK if keys else 0)))).alias(f"_e_{f}") for f in FIELDS]
        df = df.join(effect.select(*by, *shrunk), by, "left").withColumns({f"_u_{f}": F.col(f"_u_{f}") - F.coalesce(f"_e_{f}", F.lit(0.0)) for f in FIELDS}).drop(*[f"_e_{f}" for f in FIELDS])
    return df


def _spread(x: str) -> Column:
    return F.percentile_approx(F.abs(x), 0.5, 1000) * 1.4826


def phase_space(u: np.ndarray, sigma: tuple[float, float, float, float], slope: float, width: float) -> np.ndarray:
    """Flags of spikes in one series of departures ``u`` (nan: no reading, left out), with spreads as
    given: the rule of :func:`spikes` without a new estimate each pass. sigma: robust spread of value,
    first and second difference, and of the second difference less slope times value."""
    known = np.flatnonzero(~np.isnan(u))
    v, out = u[known].astype(float), np.zeros(len(known), dtype=bool)
    su, sd, s2, sr = (*sigma, 0.0)[:4]
    part = lambda x, s: (x / s) ** 2 if s > 0 else 0 * x
    while su > 0:
        d, d2, most = np.zeros_like(v), np.zeros_like(v), np.abs(v)
        d[1:-1], d2[1:-1] = (v[2:] - v[:-2]) / 2, v[2:] - 2 * v[1:-1] + v[:-2]
        rest = d2 - slope * v
        rest[[0, -1][: len(v)]] = 0
        for k in (1, 2):
            most[k:] = np.maximum(most[k:], np.abs(v[:-k]))
            most[:-k] = np.maximum(most[:-k], np.abs(v[k:]))
        outside = np.maximum.reduce([part(v, su) + part(d, sd), part(v, su) + part(rest, sr), part(d, sd) + part(d2, s2)]) > width**2
        new = ~out & ((np.abs(v) > width * su) | (outside & (np.abs(v) >= most)))
        if not new.any():
            break
        out |= new
        v = np.where(out, 0.0, v)
    flags = np.zeros(len(u), dtype=bool)
    flags[known] = out
    return flags


def _placed(points: DataFrame) -> DataFrame:
    """``points`` with ``_v``, its differences ``_d`` and ``_dd`` (null at the ends of a series) and
    ``_most``, the largest departure among it and two neighbours on each side."""
    w = Window.partitionBy("_line", "_block").orderBy("_index")
    df = points.withColumn("_v", F.when(F.col("_out"), 0.0).otherwise(F.col("u")))
    before, after = F.lag("_v").over(w), F.lead("_v").over(w)
    return df.withColumns({"_d": (after - before) / 2, "_dd": after - 2 * F.col("_v") + before, "_most": F.max(F.abs("_v")).over(w.rowsBetween(-2, 2))})


def spikes(df: DataFrame) -> DataFrame:
    """The rows (_row, match_id, kind, source, fetched_at, field, value) of ``df`` that are spikes, for
    every field. Needs ``_row``, ``_source``, ``_place``, the fields and their departures."""
    keys = ["_row", "match_id", "kind", "source", "fetched_at", "_source"]
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col(f"_u_{f}").alias("u")) for f in FIELDS]))
    points = df.select(*keys, "_place", fields.alias("x")).select(*keys, "x.*", F.concat_ws("\x1f", "x.field", "_source", "_place").alias("_line")).where("u is not null")
    counts = df.groupBy("_source").agg((WIDTH * F.sqrt(2 * F.log(F.greatest(F.count("*"), F.lit(2))))).alias("width"))
    order = ["fetched_at", "match_id", "kind", "_row"]
    state = cut(_placed(in_blocks(points.withColumn("_out", F.lit(False)), "_line", order, BLOCK, HALO)))
    passes = 0
    while True:
        if passes == PASSES:
            # what was replaced beyond a block's halo may by now reach its rows
            state, passes = cut(_placed(in_blocks(state.where("_core").select(*points.columns, "_out"), "_line", order, BLOCK, HALO))), 0
        left = state.where("_core AND NOT _out")
        # the slope of second difference on value, by medians: spikes would turn a least-squares slope
        slope = F.coalesce(F.percentile_approx(F.when(F.abs("_v") > 0, F.col("_dd") / F.col("_v")), 0.5, 1000), F.lit(0.0))
        by = left.groupBy("_source", "field").agg(_spread("_v").alias("su"), _spread("_d").alias("sd"), _spread("_dd").alias("s2"), slope.alias("slope"))
        rest = left.join(by.select("_source", "field", "slope"), ["_source", "field"]).groupBy("_source", "field").agg(F.percentile_approx(F.abs(F.expr("_dd - slope * _v")), 0.5, 1000).alias("sr"))
        known = cut(by.join(rest, ["_source", "field"]).join(counts, "_source").withColumn("sr", F.col("sr") * 1.4826))
        part = lambda x, s: F.when(F.col(s) > 0, F.coalesce((F.expr(x) / F.col(s)) ** 2, F.lit(0.0))).otherwise(0.0)
        v, d, dd = part("_v", "su"), part("_d", "sd"), part("_dd", "s2")
        outside = F.greatest(v + d, v + part("_dd - slope * _v", "sr"), d + dd) > F.col("width") ** 2
        new = ~F.col("_out") & (F.col("su") > 0) & ((F.abs("_v") > F.col("width") * F.col("su")) | (outside & (F.abs("_v") >= F.col("_most"))))
        marked = state.join(known, ["_source", "field"], "left").withColumn("_new", F.coalesce(new, F.lit(False))).withColumn("_out", F.col("_out") | F.col("_new"))
        state = cut(_placed(marked.select(*points.columns, "_index", "_block", "_core", "_out", "_new")))
        passes += 1
        if state.where("_core AND _new").isEmpty():
            break
    return state.where("_core AND _out").select(*keys[:-1], "field", "value")


def stuck(x: np.ndarray, least: int = RUN) -> np.ndarray:
    """Flags of readings in a run of at least ``least`` equal ones; nan equals nothing."""
    if not len(x):
        return np.zeros(0, dtype=bool)
    starts = np.flatnonzero(np.r_[True, ~(x[1:] == x[:-1])])
    lengths = np.diff(np.r_[starts, len(x)])
    return np.repeat(lengths >= least, lengths)


def flag(readings: DataFrame) -> DataFrame:
    """(match_id, kind, source, fetched_at, field, value, fault) of every implausible reading; fault
    is ``bound``, ``spike`` or ``stuck``, the first that holds."""
    base = readings.select("match_id", "kind", "source", "fetched_at", "place", "band", "month", "hour", *FIELDS).distinct()
    df = departures(base).select("match_id", "kind", "source", "fetched_at", "_source", "_place", *FIELDS, *[f"_u_{f}" for f in FIELDS])
    df = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    rows = df.select("_row", "match_id", "kind", "source", "fetched_at", "_source", *FIELDS)
    blocks = in_blocks(rows, "_source", ["fetched_at", "match_id", "kind", *FIELDS], BLOCK, HALO)

    def faults(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_index", kind="stable")
        core = pdf["_core"].to_numpy(dtype=bool)
        parts = []
        for f in FIELDS:
            x = pdf[f].to_numpy(dtype=float)
            low, high = BOUNDS[f]
            bound = (x < low) | (x > high)
            run = stuck(x) & ~((x == 0) if f == "precip_mm" else np.zeros(len(x), dtype=bool))
            fault = np.select([bound, run], ["bound", "stuck"], "")
            at = core & (fault != "")
            if at.any():
                part = pdf.loc[at, ["_row", "match_id", "kind", "source", "fetched_at"]].copy()
                part["field"], part["value"], part["fault"] = f, x[at], fault[at]
                parts.append(part)
        return pd.concat(parts) if parts else pd.DataFrame(columns=["_row", "match_id", "kind", "source", "fetched_at", "field", "value", "fault"])

    found = blocks.groupBy("_source", "_block").applyInPandas(faults, "_row long, match_id long, kind string, source string, fetched_at string, field string, value double, fault string")
    found = found.unionByName(spikes(df).withColumn("fault", F.lit("spike")))
    # bound, spike, stuck: the first that holds is also the first in the alphabet
    return found.groupBy("_row", "field").agg(F.min_by(F.struct("match_id", "kind", "source", "fetched_at", "field", "value", "fault"), "fault").alias("x")).select("x.*")


def weather_readings(weather: DataFrame, matches: DataFrame, venues: DataFrame, starts: DataFrame) -> DataFrame:
    """``match_weather`` with the place (canonical venue), its band of latitude, and the month and
    local hour of the match; null where unknown."""
    from fieldmark.operators.instants import date_of

    v = venues.select(F.col("id").alias("venue_id"), F.coalesce("canonical_venue_id", "id").alias("place"))
    bands = venues.groupBy(F.coalesce("canonical_venue_id", "id").alias("place")).agg(F.percentile_approx("latitude", 0.5).alias("lat"), F.percentile_approx("longitude", 0.5).alias("lon"))
    when = starts.groupBy("match_id").agg(F.min("epoch_us").alias("epoch_us"))
    day = date_of(F.coalesce("date", "kickoff_at"))
    m = matches.select(F.col("id").alias("match_id"), "venue_id", F.month(day).alias("day_month")).groupBy("match_id").agg(F.min("venue_id").alias("venue_id"), F.min("day_month").alias("day_month"))
    m = m.join(when, "match_id", "left").join(v, "venue_id", "left").join(bands, "place", "left")
    local_s = F.col("epoch_us") / 1_000_000 + F.coalesce(F.col("lon"), F.lit(145.0)) * 240
    context = m.select("match_id", "place", F.floor(F.col("lat") / 8).cast("int").alias("band"), F.coalesce(F.month(F.timestamp_seconds(local_s)), "day_month").alias("month"), ((local_s % 86400) / 3600).alias("hour"))
    return weather.select("match_id", "kind", "source", "fetched_at", *FIELDS).join(context, "match_id", "left")


def p7_found(faults: DataFrame) -> DataFrame:
    """(match_id, kind, field) of the faults."""
    return faults.select("match_id", "kind", "field").distinct()
