"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; unset (as in tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="cairnflow-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; later uses do not recompute it and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairnflow_path = path
    return out


def staged_by(df: DataFrame, name: str, key: str, parts: int, then: Callable[[DataFrame], DataFrame] = lambda dealt: dealt) -> DataFrame:
    """As ``staged``, in ``parts`` buckets of ``key``: a join or an aggregation by the key reads them without another exchange. ``then`` is what is done with the
    rows once they are dealt, and leaves them where they are (as an aggregation by the key does)."""
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    path, table = f"{shared_dir(spark)}/staged-{name}-{mark}", f"staged_{mark}"
    then(df.repartition(parts, key)).write.option("compression", "zstd").option("path", path).bucketBy(parts, key).sortBy(key).saveAsTable(table)
    out = spark.table(table)
    out._cairnflow_path = path
    spark.sql(f"DROP TABLE {table}")  # the files stay, and the frame knows them
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of staged tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_cairnflow_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
