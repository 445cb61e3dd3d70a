"""Session settings and the shared folder for tables handed from stage to stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER_KEY = "spark.checkpoint.dir"


def recommended_conf() -> dict[str, str]:
    """Settings the operators are written for; all are public Spark options."""
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # HotSpot compiles no method above 8,000 bytes of bytecode: wider generated stages would run interpreted.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the recommended settings that a running session can still change."""
    for key, value in recommended_conf().items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    On a cluster the setting is required: a folder of one machine would scatter the tables over the
    executors' disks. A local session without it (a test) gets a fresh temporary folder, and the setting
    is filled in so later calls agree.
    """
    folder = spark.conf.get(FOLDER_KEY, None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {FOLDER_KEY} to a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(FOLDER_KEY, folder)
    return folder.rstrip("/")


#: Paths of the tables staged so far, by application.
_STAGED: dict[str, list[str]] = {}


def stage_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/cohortlens/{label}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete what this application has staged, and say how many tables that were.

    Tables returned before cannot be computed again; call it once their rows are written or collected.
    """
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used at the borders where one table feeds several branches. It cuts lineage,
    survives the loss of executors, and gives Catalyst the true size of the table, so
    a later join broadcasts it only when it is small enough.
    """
    path = stage_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
