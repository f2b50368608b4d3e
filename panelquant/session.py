"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # A panel already partitioned by asset is joined on (date, asset) where it lies.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def build_session(app_name: str = "panelquant", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return ship_code(builder.getOrCreate())


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> SparkSession:
    """Gives workers this package, wherever they were started; once per application.

    The archive is written where the driver runs and served to the executors by Spark.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="panelquant-code-"), f"{package.name}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local-mode session may fall back to a folder of this machine; on a cluster an
    unset ``spark.checkpoint.dir`` is an error, because executors could not read it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="panelquant-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives executor loss and its lineage is cut."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: survives executor loss, cuts lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _scratch_folder(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "panelquant", spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in this application's part."""
    return os.path.join(_scratch_folder(spark), f"{name}-{uuid.uuid4().hex}")


def remove_scratch(spark: SparkSession) -> None:
    """Removes what this application has written below the shared folder; frames read from it end with it."""
    fs, path = filesystem(spark, _scratch_folder(spark))
    fs.delete(path, True)


def filesystem(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system that holds ``path``, and ``path`` as it takes it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place
