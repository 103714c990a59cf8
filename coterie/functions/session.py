"""What a session offers to operators that write in between."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir.

    Where it is unset, a local session (tests) gets a fresh folder of this machine; on a
    cluster that would not be shared, so RuntimeError is raised.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found and current.isDefined():
        found = current.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="coterie-")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder, wherever that is."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def settled(rows: DataFrame, *paths: str) -> DataFrame:
    """The rows written to the checkpoint folder, so that the folders they were read from can go."""
    shared_folder(rows.sparkSession)
    out = rows.checkpoint()
    for path in paths:
        remove(rows.sparkSession, path)
    return out
