"""Structured Streaming over landing folders: micro-batches merged into a table, windows with lateness."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldmark.operators.upsert import Rule, affected, latest, merge


def _files(spark: SparkSession, folder: str):
    """(file system, path of CURRENT, Hadoop's Path class) of a folder on any storage that Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    current = path(f"{folder}/CURRENT")
    return current.getFileSystem(spark._jsc.hadoopConfiguration()), current, path


def published(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table last published in ``folder``, or None."""
    fs, current, _ = _files(spark, folder)
    if not fs.exists(current):
        return None
    version = spark.read.text(current.toString()).first()[0].strip()
    return spark.read.parquet(f"{folder}/{version}")


def publish(df: DataFrame, folder: str) -> None:
    """Writes a new version beside the old one, then points CURRENT at it by one rename: readers see
    the whole old or the whole new table, and a batch that runs again publishes the same rows."""
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{version}")
    fs, current, path = _files(spark, folder)
    temporary = path(f"{folder}/.{version}")
    out = fs.create(temporary, True)
    out.write(bytearray(version.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(fs.makeQualified(temporary), fs.makeQualified(current), options)


def merge_stream(stream: DataFrame, folder: str, manifest: list[Rule], order: str, rebuild: str, checkpoint: str, on_affected=None) -> StreamingQuery:
    """Merges each micro-batch into the table of ``folder``. ``order``: of rows of one key in a batch
    the one with the greatest value counts. ``on_affected`` gets the values of ``rebuild`` in changed
    rows, for derived tables."""
    keys = [r.column for r in manifest if r.how == "key"]

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, keys, [F.col(order).desc_nulls_last()])
        old = published(spark, folder)
        merged = merge(old if old is not None else spark.createDataFrame([], batch.schema), new, manifest, (rebuild,)).persist()
        if on_affected is not None:
            on_affected(affected(merged, rebuild))
        publish(merged.drop("_change", f"_was_{rebuild}"), folder)
        merged.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by tumbling window of ``events(ts, event_type, value)``; works on
    streams, where rows later than ``lateness`` are dropped by the watermark, and on tables."""
    counted = events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")
