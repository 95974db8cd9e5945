"""Intermediate results that are computed once, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_local: dict[str, str] = {}
_one_at_a_time = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a folder of this machine only under a local master that names none."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="palisade-guard-")
    return _local[app]


def once(df: DataFrame) -> DataFrame:
    """Spark's reliable checkpoint: computed now, read from the shared folder from then on."""
    sc = df.sparkSession.sparkContext
    with _one_at_a_time:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
