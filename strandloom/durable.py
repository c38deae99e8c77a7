"""Durable cuts of lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for durable intermediate tables.

    ``spark.checkpoint.dir`` wins; a local temporary folder is made only where the setting is
    absent and the master is local (tests), never on a cluster.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="strandloom-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def root(spark: SparkSession) -> str:
    """This application's folder below the shared one; it is deleted when the driver's Python ends."""
    context = spark.sparkContext
    if context.applicationId not in _ROOTS:
        path = f"{shared_dir(spark)}/strandloom-{context.applicationId}"
        _ROOTS[context.applicationId] = path
        atexit.register(_deleted, context._jvm, context._jsc.hadoopConfiguration(), path)
    return _ROOTS[context.applicationId]


def clear(spark: SparkSession) -> None:
    """Delete what this application has cut so far: for long sessions, once a result is written."""
    path = _ROOTS.get(spark.sparkContext.applicationId)
    if path:
        _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


def _delete(jvm, conf, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def _deleted(jvm, conf, path: str) -> None:
    try:
        _delete(jvm, conf, path)
    except Exception:  # the virtual machine may have ended first
        pass


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This ends the lineage (a lost executor costs no recomputation of what is upstream), and
    leaves a columnar table whose unused columns later readers skip.
    """
    spark = df.sparkSession
    path = f"{root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
