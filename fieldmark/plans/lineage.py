"""Cutting lineage through storage that every executor shares."""

import tempfile

from pyspark.sql import DataFrame, SparkSession

CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one for a local master, as
    in tests; on a cluster that raises, as no machine's own folder would do."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    wanted = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not wanted and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # a checkpoint's files go once nothing refers to it any more, unless the session says otherwise
    conf = sc._jsc.sc().conf()
    if not conf.contains(CLEAN):
        conf.set(CLEAN, "true")
    sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="fieldmark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a reliable checkpoint, so that reuse does not recompute it
    and the loss of an executor does not lose it. Its files are removed once it is no longer used."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
