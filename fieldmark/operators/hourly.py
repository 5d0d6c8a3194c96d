"""Hourly series around an instant: strict aggregates of a window, and of the day before it.

Windows are joined on generated hour keys, so the join is an equality. Strict means that an hour that
is missing, null or stated twice makes the metric null: an unknown hour never becomes a measured 0.

Defined results: instants are floored to the hour; series without any value of a metric give null;
of several models the first in order of preference that has any value for the metric is taken, for
the series as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOURS, PRIOR = 3, 24
# Metric, aggregate and decimals.
METRICS = (("temp", "mean", 1), ("humidity", "mean", 1), ("precip", "sum", 2), ("wind", "max", None), ("gust", "max", None))


def half_up(x: Column, decimals: int) -> Column:
    """Rounding with halves towards plus infinity, also for negative numbers."""
    p = 10.0**decimals
    return F.floor(x * p + 0.5) / p


def prefer(hours: DataFrame, models: list[str]) -> DataFrame:
    """(series, hour, metrics) of ``hours(series, model, hour, metrics)``: for each series and metric
    the first model with data."""
    names = [m for m, _, _ in METRICS]
    order = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    known = hours.where(order > 0).withColumn("_o", order)
    first = known.groupBy("series").agg(*[F.min(F.when(F.col(n).isNotNull(), F.col("_o"))).alias(f"_{n}") for n in names])
    joined = known.join(first, "series")
    # an hour that the chosen model states twice stays twice
    picked = [F.when(F.col("_o") == F.col(f"_{n}"), F.col(n)).alias(n) for n in names]
    flags = [(F.col("_o") == F.col(f"_{n}")).alias(f"has_{n}") for n in names]
    return joined.select("series", "hour", *picked, *flags)


def windows(targets: DataFrame, hours: DataFrame) -> DataFrame:
    """(id, metrics, prior_precip) for ``targets(id, series, start)`` from ``hours(series, hour, metrics)``
    with ``start`` and ``hour`` in seconds since 1970 UTC."""
    t = targets.select("id", "series", F.expr("start - pmod(start, 3600)").alias("start"))
    wanted = t.select("id", "series", F.explode(F.transform(F.sequence(F.lit(-PRIOR), F.lit(HOURS - 1)), lambda k: F.struct((F.col("start") + k * 3600).alias("hour"), (k < 0).alias("prior")))).alias("w")).select("id", "series", "w.*")
    names = [m for m, _, _ in METRICS]
    counts = hours.groupBy("series", "hour").agg(F.count("*").alias("_times"), *[F.first(n).alias(n) for n in names])
    got = wanted.join(counts, ["series", "hour"], "left")
    one = F.col("_times") == 1
    out = []
    for name, how, decimals in METRICS:
        v = F.when(~F.col("prior") & one, F.col(name))
        agg = {"mean": F.avg, "sum": F.sum, "max": F.max}[how](v)
        out.append(F.when(F.count(v) == HOURS, agg if decimals is None else half_up(agg, decimals)).alias(name))
    before = F.when(F.col("prior") & one, F.col("precip"))
    out.append(F.when(F.count(before) == PRIOR, half_up(F.sum(before), 2)).alias("prior_precip"))
    return got.groupBy("id").agg(*out)
