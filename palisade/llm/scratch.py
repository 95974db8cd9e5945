"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset (tests, a single
machine) a temporary folder of this machine is set.  Tables are written by Spark's committers, so
a lost executor only repeats tasks.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
#: Spark deals rows to Arrow by number only unless this is set; long texts would make large batches.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
_made: list[tuple[SparkSession, str, str]] = []
#: Who keeps tables now; without an owner they stay until the folder is cleared.
_owner: ContextVar[str] = ContextVar("owner", default="")
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a local one is set only if the session names none and runs on this machine alone."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="palisade-")
        spark.sparkContext.setCheckpointDir(_local[app])
    return _local[app]


def bound_batches(spark: SparkSession) -> None:
    """Limit the bytes of an Arrow batch, unless the session has a limit of its own."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/palisade-{uuid.uuid4().hex}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path, _owner.get()))
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Spark's reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def owned(owner: str):
    """Tables kept inside belong to this owner until :func:`release`; owners may nest and stand in several threads."""
    token = _owner.set(owner)
    try:
        yield
    finally:
        _owner.reset(token)


def release(owner: str) -> None:
    """Delete the tables that an owner kept so far; those of other owners stay."""
    for entry in [x for x in _made if x[2] == owner]:
        _made.remove(entry)
        spark, path, _ = entry
        delete(spark, path.rsplit("/", 1)[0])


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception as e:  # the session may have ended
        print(f"scratch table not deleted: {path}: {type(e).__name__}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below sf_dir."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
