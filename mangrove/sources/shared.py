"""The folder that all executors and the driver see, and what is written there between passes."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_swept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under `spark.checkpoint.dir`. Where that is unset, a local master gets a folder of this process (tests); on a cluster it is an error."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="mangrove-")
        context.setCheckpointDir(where)
    own = f"{where.rstrip('/')}/mangrove-{context.applicationId}"
    if own not in _swept:
        _swept.add(own)
        atexit.register(_sweep, spark, own)
    return own


def _sweep(spark: SparkSession, folder: str) -> None:
    """At the end of the process; where the context or its JVM is gone already, the folder stays."""
    with contextlib.suppress(Py4JError, OSError):
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            delete(spark, folder)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back, so that later passes and retries start from files."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what `materialise` wrote, once everything made of it is written itself."""
    for df in frames:
        delete(df.sparkSession, df.stored_at)
