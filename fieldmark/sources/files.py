"""Text files with a stated schema: nothing is inferred, and broken rows are kept aside."""

from pyspark.sql import DataFrame, SparkSession

#: Columns of the venue seed file.
VENUE_SEED = "venue_id long, name string, latitude double, longitude double, timezone string, roof string, canonical_venue_id long, confidence string, notes string"


def read_csv(spark: SparkSession, path: str, schema: str = VENUE_SEED) -> DataFrame:
    """CSV with a header; a row that does not fit the schema has its text in ``_broken``."""
    return spark.read.csv(path, header=True, schema=f"{schema}, _broken string", columnNameOfCorruptRecord="_broken", mode="PERMISSIVE", escape='"', multiLine=True)


def read_hourly_json(spark: SparkSession, path: str, metrics: tuple[str, ...]) -> DataFrame:
    """(series, hour, metrics) of JSON documents that hold parallel arrays: one object a line with
    ``series`` and ``hourly``, whose ``time`` is in seconds since 1970 UTC. Arrays that are shorter
    than the time axis give nulls at its end."""
    from pyspark.sql import functions as F

    arrays = ", ".join(f"{m}: array<double>" for m in metrics)
    doc = spark.read.schema(f"series string, hourly struct<time: array<long>, {arrays}>").json(path)
    zipped = doc.select("series", F.explode(F.arrays_zip("hourly.time", *[f"hourly.{m}" for m in metrics])).alias("z"))
    return zipped.select("series", F.col("z.time").alias("hour"), *[F.col(f"z.{m}").alias(m) for m in metrics])
