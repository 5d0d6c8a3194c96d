"""Ordered series in bounded blocks: a series of any length is cut into blocks of equal numbers of
rows, each with copies of its neighbours' nearest rows, so that no task holds a whole series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.plans.lineage import cut


def in_blocks(df: DataFrame, series: str, order: list[str], rows: int, halo: int) -> DataFrame:
    """``df`` with ``_index`` (place in its series, from 0), ``_block`` and ``_core``.

    Every row comes once as core of its block and again, not core, in each block of which it lies
    within ``halo`` rows. The place is found by one range partitioning over (series, order), the
    row's number within its partition and the sums over earlier partitions; one series may fill any
    number of partitions. ``halo`` must not exceed ``rows``. ``order`` should settle ties.
    """
    if halo > rows:
        raise ValueError("halo exceeds the rows of a block")
    keys = [series, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    placed = cut(placed.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_nth")).drop("_id"))
    # one row for each partition and series: as many rows as partitions plus series
    counts = placed.groupBy(series, "_part").agg(F.count("*").alias("_n"), F.min("_nth").alias("_first"))
    # running sums over a series' partitions: of one series no more rows than there are partitions
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(series).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(series).alias("_series"), F.col("_part").alias("_p"), "_first", before.alias("_before"))
    indexed = placed.join(offsets, (F.col("_part") == F.col("_p")) & F.col(series).eqNullSafe(F.col("_series")))
    indexed = indexed.withColumn("_index", F.col("_before") + F.col("_nth") - F.col("_first")).drop("_part", "_nth", "_p", "_series", "_first", "_before")
    block = F.expr(f"_index div {rows}")
    within = F.col("_index") % rows
    copies = F.array_compact(F.array(block, F.when((within < halo) & (block > 0), block - 1), F.when(within >= rows - halo, block + 1)))
    return indexed.withColumn("_block", F.explode(copies)).withColumn("_core", F.col("_block") == block)
